"""Ranking a stream of queries: each micro-batch is ranked as one batch against the index.

The index is static, so the stream needs no state and no watermark; a batch that is tried again overwrites its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.rank import rank
from ..plans.index import Index


def rank_stream(index: Index, queries: DataFrame, out: str, checkpoint: str, model: str = "bm25", depth: int = 25) -> StreamingQuery:
    """Rank a streaming (query_id, text) table; every batch becomes a folder batch=N of Parquet under out."""

    def write(batch: DataFrame, number: int) -> None:
        rank(index, batch.dropDuplicates(["query_id"]), model, depth).drop("pos").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
