"""The versioned reads over streams: windows with late data, the last version of each document, and journals as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours", time: str = "ts", by: str = "event_type") -> DataFrame:
    """by, start, n, total of tumbling windows; rows later than `late` go. The same plan runs on a batch."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    stream = timed.withWatermark(time, late) if events.isStreaming else timed
    return stream.groupBy(F.window(time, every), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(by, F.col("window.start").alias("start"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", by: str = "user_id") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    stream = timed.withWatermark(time, late) if events.isStreaming else timed
    return stream.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def publish_batches(target: str):
    """A foreachBatch function that keeps a view of each document's last version; a batch that comes again changes nothing.

    Of two tables the view shows one. A batch writes the other, and then the view turns to it, so a failure between leaves
    what was there before.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        from ..operators.versioning import upsert

        spark = batch.sparkSession
        rows = batch.select("doc_id", "version", "kind")
        shown = spark.catalog.getTable(target).description if spark.catalog.tableExists(target) else None
        if shown:
            rows = rows.unionByName(spark.table(target).select("doc_id", "version", "kind"))
        other = "b" if shown == "a" else "a"
        upsert(rows.distinct(), ["doc_id"], "version").write.mode("overwrite").saveAsTable(f"{target}_{other}")
        spark.sql(f"CREATE OR REPLACE VIEW {target} COMMENT '{other}' AS SELECT * FROM {target}_{other}")

    return run


def journal_stream(events: DataFrame, needed: list[str]) -> DataFrame:
    """id, status, ready of journals as their artifacts (id, artifact) come: staged until all needed ones are ready."""
    want = set(needed)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ready = set(state.get[0].split(",")) - {""} if state.exists else set()
        for pdf in parts:
            ready |= set(pdf["artifact"])
        state.update((",".join(sorted(ready)),))
        yield pd.DataFrame({"id": [key[0]], "status": ["published" if want <= ready else "staged"], "ready": [",".join(sorted(ready))]})

    return events.groupBy("id").applyInPandasWithState(run, "id string, status string, ready string", "ready string", "update", "NoTimeout")
