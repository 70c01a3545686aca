"""The transaction file stream feeds micro-batches to batch operators."""

from __future__ import annotations

import os
import tempfile

from shelfwise.operators import descriptive as D
from shelfwise.streaming import stream_transactions
from tests.conftest import sale


def test_stream_feeds_batch_operator(spark, make_tx):
    base = tempfile.mkdtemp(prefix="stream-")
    src = os.path.join(base, "in")
    make_tx([sale("A", 1, 1, "2023-01-01"), sale("B", 2, 1, "2023-01-02")]).drop(
        "purchase_date", "year", "month", "weekday", "hour", "month_start"
    ).write.parquet(src)
    seen = []

    def per_batch(df, epoch):
        seen.extend(D.dataset_summary(df).collect())

    q = (stream_transactions(spark, src).writeStream.foreachBatch(per_batch)
         .option("checkpointLocation", os.path.join(base, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert sum(r.rows for r in seen) == 2
