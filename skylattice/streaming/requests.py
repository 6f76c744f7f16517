"""Route requests as a stream: each micro-batch is planned against one snapshot's tables. An
extension; the edge table is made once and shared by all batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from skylattice.plans.search import navigable_edges, plan_routes
from skylattice.tables import settled


def plan_stream(requests: DataFrame, airports: DataFrame, navaids: DataFrame, out: str, checkpoint: str, factor: float = 1.5) -> StreamingQuery:
    """Plans go to Parquet under ``out``, a folder for each batch, so a batch that is run again
    replaces itself."""
    edges = settled(navigable_edges(navaids))

    def put(batch: DataFrame, number: int) -> None:
        plan_routes(batch, airports, navaids, factor, edges).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    return requests.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
