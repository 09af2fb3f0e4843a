"""Several stored artifacts behind one manifest: what is half written is never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The artifacts made of each document.
ARTIFACTS = ("dense", "sparse", "graph", "cache")


class Publication:
    """Artifacts (doc_id, version, payload) below one folder, with a manifest of each document's active version.

    A batch stages each artifact in a folder of its own, overwritten when it is staged again, so that a retry leaves no
    repeated rows. `publish` tests the staged batch, writes its rows of the manifest, and at last one row of `commits`: a
    single small file, which the job's commit moves into place whole. Readers take the manifest's rows of committed batches
    alone, and rows of the very batch and version that it names. So whatever ends between two writes (a lost driver, too)
    leaves readers with the version before, over all artifacts. A frame lists its files when it is made: later writes don't
    reach it. Null doc_ids are never published.
    """

    def __init__(self, spark: SparkSession, folder: str, artifacts: tuple[str, ...] = ARTIFACTS):
        self.spark, self.folder, self.artifacts = spark, folder.rstrip("/"), artifacts
        for part, schema in (("commits", "done int"), ("manifest", "doc_id long, version long")):  # batch 0 is empty
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.folder}/{part}/batch=0")

    def _batches(self, part: str, schema: str) -> DataFrame:
        # one folder a batch, each a root of its own: Spark takes frames of the same roots for the same, whatever files they listed
        root = f"{self.folder}/{part}"
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", root).parquet(f"{root}/batch=*")

    def stage(self, batch: int, artifact: str, rows: DataFrame) -> None:
        """Writes (doc_id, version, payload) of one artifact; other columns don't matter."""
        rows.select(F.col("doc_id").cast("long"), F.col("version").cast("long"), F.col("payload").cast("string")).write.mode("overwrite").parquet(f"{self.folder}/{artifact}/batch={batch}")

    def staged(self, artifact: str) -> DataFrame:
        """doc_id, version, payload, batch of all that was ever staged, published or not."""
        return self._batches(artifact, "doc_id long, version long, payload string")

    def readiness(self, batch: int) -> DataFrame:
        """doc_id, version, ready: whether every artifact holds exactly one row of that version, and no other version, in the batch."""
        rows = None
        for a in self.artifacts:
            part = self.staged(a).where(F.col("batch") == batch).select("doc_id", "version", F.lit(a).alias("a"))
            rows = part if rows is None else rows.unionByName(part)
        got = rows.groupBy("doc_id").agg(F.min("version").alias("version"), F.max("version").alias("_v"), F.count("*").alias("_n"), F.count_distinct("a").alias("_a"))
        whole = (F.col("version") == F.col("_v")) & (F.col("_n") == len(self.artifacts)) & (F.col("_a") == len(self.artifacts)) & F.col("doc_id").isNotNull()
        return got.select("doc_id", "version", F.coalesce(whole, F.lit(False)).alias("ready"))

    def write_manifest(self, batch: int, rows: DataFrame) -> None:
        rows.select("doc_id", "version").write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch}")

    def commit(self, batch: int) -> None:
        self.spark.createDataFrame([(1,)], "done int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch={batch}")

    def publish(self, batch: int) -> None:
        """Makes a staged batch the active version of its documents, all at once; raises and changes nothing if one isn't whole."""
        state = self.readiness(batch)
        bad = state.where(~F.col("ready")).count()
        if bad:
            raise ValueError(f"batch {batch}: {bad} documents lack an artifact or have several versions")
        self.write_manifest(batch, state)
        self.commit(batch)

    def manifest(self) -> DataFrame:
        """doc_id, version, batch: the last committed entry of each document."""
        done = self._batches("commits", "done int").where("done = 1")
        entries = self._batches("manifest", "doc_id long, version long").join(done, "batch", "left_semi")
        return entries.groupBy("doc_id").agg(F.max_by("version", "batch").alias("version"), F.max("batch").alias("batch"))

    def read(self, artifact: str, manifest: DataFrame | None = None) -> DataFrame:
        """doc_id, version, payload of the active versions. One manifest given to several reads makes them one snapshot."""
        active = self.manifest() if manifest is None else manifest
        return self.staged(artifact).join(active, ["doc_id", "version", "batch"], "left_semi").select("doc_id", "version", "payload")

    def garbage(self, artifact: str) -> DataFrame:
        """Staged rows that no reader sees: older versions, and batches that weren't committed."""
        return self.staged(artifact).join(self.manifest(), ["doc_id", "version", "batch"], "left_anti")

    def observed(self, filtered: bool) -> DataFrame:
        """doc_id, active, and for each artifact the sorted versions that a read sees now: all that are staged, or, filtered,
        those of the active version."""
        manifest = self.manifest()
        out = manifest.select("doc_id", F.col("version").alias("active"))
        for a in self.artifacts:
            rows = self.staged(a).select("doc_id", "version")
            if filtered:
                rows = rows.join(manifest.select("doc_id", "version"), ["doc_id", "version"], "left_semi")
            seen = rows.groupBy("doc_id").agg(F.array_sort(F.collect_set("version")).alias(a))
            out = out.join(seen, "doc_id", "left").withColumn(a, F.coalesce(a, F.array().cast("array<bigint>")))
        return out


def wrong(artifact: str) -> Column:
    """Whether a read of an artifact saw anything but the active version."""
    return F.col(artifact) != F.array("active")


def rehearse(target: Publication, old: dict[str, DataFrame], new: dict[str, DataFrame], manifest_first: bool) -> list[tuple[str, DataFrame, DataFrame]]:
    """Writes batch 1 of old artifacts and publishes it, then batch 2 of new ones step by step; after each step what a plain and
    a filtered read see: (checkpoint, plain, filtered).

    manifest_first publishes before the artifacts are there (the error that reads are tested for); otherwise all artifacts
    are staged, then tested, then published.
    """
    out = []

    def look(name: str) -> None:
        out.append((name, target.observed(False), target.observed(True)))

    for a in target.artifacts:
        target.stage(1, a, old[a])
    target.publish(1)
    look("initial")
    if manifest_first:
        target.write_manifest(2, new[target.artifacts[0]])
        target.commit(2)
        look("manifest_published")
    for a in target.artifacts:
        target.stage(2, a, new[a])
        look(f"{a}_staged")
    if not manifest_first:
        target.publish(2)
        look("manifest_published")
    return out


def error_rates(reads: DataFrame, artifacts: tuple[str, ...], by: list[str]) -> DataFrame:
    """by, observations, errors (any artifact is wrong), errors of each artifact, rate and its Wilson interval."""
    from .stats import wilson

    any_ = F.lit(False)
    for a in artifacts:
        any_ = any_ | wrong(a)
    c = reads.groupBy(*by).agg(F.count("*").alias("observations"), F.count_if(any_).alias("errors"), *[F.count_if(wrong(a)).alias(f"{a}_errors") for a in artifacts])
    lo, hi = wilson(F.col("errors"), F.col("observations"))
    return c.select("*", F.round(F.col("errors") / F.col("observations"), 9).alias("rate"), lo.alias("lo"), hi.alias("hi"))
