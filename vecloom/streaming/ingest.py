"""Inserting a stream of vectors into an index, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vecloom.sources.catalog import Catalog


def insert_stream(catalog: Catalog, name: str, rows: DataFrame, checkpoint: str) -> StreamingQuery:
    """Each micro-batch becomes part of the delta; what is available is worked off, then the query ends."""

    def add(batch: DataFrame, _: int) -> None:
        catalog.insert(name, batch)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
