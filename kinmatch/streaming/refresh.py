"""Polling refresh as a stream: each trigger replaces the rows of the sites that sent any.

Micro-batches run one at a time, and the next starts when the one before is done, so rounds never
overlap. A site without usable rows in a batch keeps what is stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinmatch.functions.text import blank
from kinmatch.resources import catalog


def store_batch(batch: DataFrame, path: str) -> list[str]:
    """Replaces the partitions of the batch's sites in a table partitioned by site; the sites written."""
    known = [k for k, _, _ in catalog.SPORTS]
    rows = batch.where(F.col("sport").isin(*known) & (blank(F.col("site")) != "")).persist()
    sites = [r.site for r in rows.select("site").distinct().collect()]
    if sites:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(path)
    rows.unpersist()
    return sites


def refresh(listings: DataFrame, path: str, checkpoint: str, every: str = "120 seconds", after: Callable[[list[str]], None] | None = None, once: bool = False) -> StreamingQuery:
    """listings: a stream with site and sport. after: called with the sites of each round, as to compare again."""

    def round_(batch: DataFrame, _: int) -> None:
        sites = store_batch(batch, path)
        if sites and after:
            after(sites)

    writer = listings.writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
