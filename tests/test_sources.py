"""Loaders, schema check, calendar columns, enriched join, sink."""

from __future__ import annotations

import os
import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shelfwise.sources import enrich, load_transactions
from shelfwise.sources import tpch
from shelfwise.sources.schemas import TRANSACTIONS_SCHEMA, check_schema
from shelfwise.sources.sinks import write_transactions
from shelfwise.operators.quality import schema_report
from tests.conftest import SF_SMALL, sale


def test_calendar_columns_and_iso_weekday(make_tx):
    # 2023-01-01 is a Sunday: ISO weekday 7, week bucket starts 2022-12-26.
    df = make_tx([sale("INV-1", 1, 1, "2023-01-01", hour=21)])
    r = df.first()
    for c in ("purchase_date", "year", "month", "weekday", "hour", "month_start"):
        assert c in df.columns
    assert r.weekday == 7 and r.hour == 21 and str(r.month_start) == "2023-01-01"


def test_enriched_left_joins_keep_facts(make_tx, make_products, make_customers):
    tx = make_tx([sale("INV-1", 1, 1, "2023-02-01"), sale("INV-2", 99, 77, "2023-02-02")])
    prod = make_products([(1, "SKU-000001", "Toys", 5.0, 0.3, 10)])
    cust = make_customers([(1, None, "FR")])
    e = enrich(tx, cust, prod).orderBy("invoice_id").collect()
    assert len(e) == 2
    assert e[0].country == "FR" and e[0].category == "Toys" and e[0].margin_pct == 0.3
    assert e[1].country is None and e[1].category is None


def test_schema_check_names_problems(spark):
    df = spark.createDataFrame([("x", 1)], "invoice_id string, customer_id string")
    with pytest.raises(ValueError) as ei:
        check_schema(df, TRANSACTIONS_SCHEMA, "transactions")
    msg = str(ei.value)
    assert "missing column 'product_id'" in msg and "'customer_id' is string" in msg


def test_schema_report(spark):
    tx = tpch.transactions(spark, SF_SMALL)
    rep = schema_report(spark, {"transactions": tx}).collect()
    assert len(rep) == len(TRANSACTIONS_SCHEMA.fields)
    assert all(r.ok for r in rep)  # decimal money counts as fractional


def test_nanosecond_parquet_is_read(spark):
    folder = tempfile.mkdtemp(prefix="ns-")
    path = os.path.join(folder, "tx.parquet")
    t = pa.table({
        "invoice_id": ["INV-00000001"], "customer_id": pa.array([1], pa.int64()),
        "product_id": pa.array([2], pa.int64()),
        "purchase_ts": pa.array([1672574400123456789], pa.timestamp("ns")),
        "quantity": pa.array([3], pa.int32()), "unit_price": pa.array([1.5], pa.float32()),
        "discount_pct": pa.array([0.0], pa.float32()), "net_revenue": pa.array([4.5], pa.float32()),
        "profit": pa.array([1.0], pa.float32()),
    })
    pq.write_table(t, path)
    r = load_transactions(spark, path, nanos_timestamps=True).first()
    assert str(r.purchase_ts) == "2023-01-01 12:00:00.123456"
    assert r.weekday == 7


def test_sink_roundtrip_sorted(spark, make_tx):
    import glob

    rows = [sale(f"INV-{i}", 1, 1, f"2023-0{1 + i % 3}-1{i}") for i in range(6)]
    out = os.path.join(tempfile.mkdtemp(prefix="sink-"), "tx")
    write_transactions(make_tx(rows), out, partitions=2)
    assert spark.read.parquet(out).count() == 6
    ranges = []
    for f in sorted(glob.glob(os.path.join(out, "*.parquet"))):
        t = pq.read_table(f).column("purchase_ts").to_pylist()
        assert t == sorted(t)  # each file is sorted
        if t:
            ranges.append((t[0], t[-1]))
    ranges.sort()
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))  # files do not overlap


def test_adapter_matches_model(spark):
    t = tpch.retail_tables(spark, SF_SMALL)
    tx = t.transactions
    for c in ("invoice_id", "customer_id", "product_id", "purchase_ts", "quantity",
              "net_revenue", "profit", "purchase_date", "month_start"):
        assert c in tx.columns
    r = tx.first()
    assert r.invoice_id.startswith("INV-") and len(r.invoice_id) >= 12
    p = t.products.first()
    assert 0.05 <= p.margin_pct <= 0.75 and 5 <= p.stock_on_hand <= 1999


def test_default_paths_from_session_setting(spark, make_tx):
    from shelfwise.sources.tables import DATA_DIR_CONF, load_transactions as lt

    folder = tempfile.mkdtemp(prefix="data-")
    make_tx([sale("INV-1", 1, 1, "2023-01-01")]).drop(
        "purchase_date", "year", "month", "weekday", "hour", "month_start"
    ).write.parquet(os.path.join(folder, "transactions.parquet"))
    spark.conf.set(DATA_DIR_CONF, folder)
    try:
        df = lt(spark, cache=True)
        assert df.count() == 1 and df.is_cached
    finally:
        spark.conf.unset(DATA_DIR_CONF)
    with pytest.raises(ValueError):
        lt(spark)


def test_checkpoint_folder_must_be_named_off_local_masters(spark, monkeypatch):
    import pytest as _pytest

    from shelfwise import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Fake:
        conf = Conf()

    monkeypatch.setattr(session, "_context", lambda s: None)
    with _pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Fake())


def test_held_frames_are_released(spark):
    from shelfwise.session import hold, release

    df = hold(spark.range(5))
    assert df.count() == 5 and df.is_cached
    assert release() >= 1 and not df.is_cached


def test_sink_spreads_one_timestamp_and_bounds_files(make_tx, tmp_path):
    import glob

    import pyarrow.parquet as pq

    from shelfwise.sources.sinks import write_transactions
    from tests.conftest import sale

    rows = [sale(f"I{i}", i, i % 50, "2023-06-01") for i in range(2_000)]
    rows += [sale("same", 1, 1, "2023-06-02")] * 500 + [sale(f"L{i}", i, 2, "2023-07-01") for i in range(500)]
    tx = make_tx(rows)
    write_transactions(tx, str(tmp_path / "out"), 8, rows_per_file=300)
    files = glob.glob(str(tmp_path / "out" / "*.parquet"))
    tables = [pq.read_table(f, columns=["invoice_id", "purchase_ts"]).to_pydict() for f in files]
    assert sum(len(t["invoice_id"]) for t in tables) == 3_000 and max(len(t["invoice_id"]) for t in tables) <= 300
    assert all(t["purchase_ts"] == sorted(t["purchase_ts"]) for t in tables)
    tasks = {f.split("part-")[1][:5] for f, t in zip(files, tables) if "I0" <= min(t["invoice_id"]) < "J"}
    assert len(tasks) >= 4  # one day's rows lie in several tasks
    july = [f for f, t in zip(files, tables) if any(str(x) >= "2023-07" for x in t["purchase_ts"])]
    assert len(july) < len(files) / 2
