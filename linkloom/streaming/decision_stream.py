"""The decision log as a stream: every micro-batch is applied to the table of links.

A batch that is delivered again after a failure changes nothing, as a change with an order that is stored already is
dropped; so the sink is exactly-once in effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from linkloom.operators.change_feed import DeltaTable, decision_changes


class LinkStream:
    """Keeps the current links of a stream of decisions under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.table = DeltaTable(spark, root, ["requirementId", "proposedSymbolId"], ["moment", "seq"], ["symbolId"])

    def _apply(self, batch: DataFrame, _: int) -> None:
        self.table.apply(decision_changes(batch))

    def start(self, decisions: DataFrame, checkpoint: str) -> StreamingQuery:
        """``decisions`` is a streaming DataFrame with the columns of the decision log."""
        return decisions.writeStream.foreachBatch(self._apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def links(self) -> DataFrame:
        return self.table.read().select("requirementId", "proposedSymbolId", "symbolId", "seq")
