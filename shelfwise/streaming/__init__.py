"""Transactions as a file stream.

The analytics themselves are batch operations; there is no streaming
operator to mirror (no watermark, window or state in the model). What a
streaming deployment needs is the same canonical frame arriving
incrementally: ``stream_transactions`` reads new Parquet files of a folder as
a stream with the enforced transaction schema and the calendar columns, so
micro-batches can be handed to the batch operators through ``foreachBatch``.
"""

from shelfwise.streaming.source import stream_transactions

__all__ = ["stream_transactions"]
