"""Leaderboard kept up to date while result records arrive."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.report import IDENTITY, leaderboard


def refresh(records: DataFrame, store: str, checkpoint: str) -> None:
    """Appends each micro-batch of records to the journal ``store`` under its batch number. A replayed
    batch overwrites its own folder, so the journal holds every record once."""
    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{store}/part={number}")

    query = records.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current_board(journal: DataFrame) -> DataFrame:
    """Leaderboard over the latest record of every identity."""
    others = [c for c in journal.columns if c not in IDENTITY]
    latest = journal.groupBy(*IDENTITY).agg(F.max_by(F.struct(*others), F.struct("batch", "order_no")).alias("r"))
    return leaderboard(latest.select(*IDENTITY, "r.*"))
