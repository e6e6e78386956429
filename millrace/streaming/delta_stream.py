"""The incremental merge as a stream: each micro-batch is one delta run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.delta import delta
from millrace.plans.session import cut
from millrace.plans.state import StateTable


def merge_stream(stream: DataFrame, table: StateTable, key: str, hash_column: str | None, order: str, checkpoint: str) -> StreamingQuery:
    """Merge what a stream has available into ``table`` by ``key``, skipping rows whose hash is known.

    State is keyed by content, so a batch that is delivered again after a failure changes nothing and no
    watermark is needed. A batch rewrites the buckets of its keys alone (``table`` must have ``key``). Of several rows of a key in one batch the one with the greatest ``order`` holds.
    """

    if table.key != key:
        raise ValueError("merge_stream: the table's key must be the stream's")

    def apply(batch: DataFrame, _: int) -> None:
        stored = table.read()
        names = batch.columns
        last = batch.groupBy(key).agg(F.max(F.struct(F.col(order).alias("__o"), F.struct(*names).alias("__row"))).alias("m")).select("m.__row.*")
        new = cut(delta(last, stored, key, hash_column))
        if not new.isEmpty():
            table.merge(new)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
