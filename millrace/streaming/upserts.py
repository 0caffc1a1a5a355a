"""The upsert of batches as a stream: each micro-batch of landed postings is merged into the buckets of the snapshot that it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.operators.state import upsert

SNAPSHOT = "job_id_hash string, first_seen double, last_seen double, source_names array<string>, authentic_status string"


#: Buckets of the snapshot, by hash of the key; a micro-batch rewrites those that its keys fall in.
BUCKETS = 64


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _manifest(spark: SparkSession, path: str, epoch: int | None = None) -> tuple[int, dict[str, int]]:
    """The newest complete epoch (or the newest before a given one) and the version that each bucket has in it; -1 and no buckets before the first."""
    fs, folder = _fs(spark, f"{path}/manifests")
    if not fs.exists(folder):
        return -1, {}
    done = [int(n) for n in (s.getPath().getName() for s in fs.listStatus(folder)) if n.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, f"{n}/_SUCCESS"))]
    last = max((n for n in done if epoch is None or n < epoch), default=-1)
    if last < 0:
        return -1, {}
    rows = spark.read.schema("bucket int, version int").parquet(f"{path}/manifests/{last}").collect()  # BUCKETS rows at most
    return last, {r.bucket: r.version for r in rows}


def _read(spark: SparkSession, path: str, versions: dict[int, int]) -> DataFrame:
    if not versions:
        return spark.createDataFrame([], SNAPSHOT)
    return spark.read.schema(SNAPSHOT).parquet(*[f"{path}/v{v}/bucket={b}" for b, v in sorted(versions.items())])


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete state under a path; empty before the first."""
    return _read(spark, path, _manifest(spark, path)[1])


def merge_batch(path: str):
    """A function for foreachBatch: it rewrites the buckets that the batch's keys fall in, then lists all buckets' versions in a manifest.

    A batch that is run again after a failure writes the same versions from the same base, so the result is that of one
    run. Versions that neither the new manifest nor the one before it lists are removed.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before, versions = _manifest(spark, path, epoch)
        bucket = F.pmod(F.xxhash64("job_id_hash"), F.lit(BUCKETS)).cast("int")
        seen = batch.where("job_id_hash is not null").select(F.lower("job_id_hash").alias("job_id_hash"), (F.unix_micros(F.col("arrived_at").cast("timestamp")) / 1e6).alias("seen"), "source_name", F.lit("AUTHENTIC").alias("authentic_status"))
        touched = [r[0] for r in seen.select(bucket.alias("b")).distinct().collect()]  # BUCKETS at most
        held = _read(spark, path, {b: versions[b] for b in touched if b in versions})
        after = upsert(held, seen).drop("is_new").withColumn("bucket", bucket)
        after.repartition(max(1, len(touched)), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{epoch}")
        now = versions | dict.fromkeys(touched, epoch)
        spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{epoch}")
        fs, folder = _fs(spark, path)
        for s in fs.listStatus(folder):
            name = s.getPath().getName()
            if name[:1] == "v" and name[1:].isdigit() and int(name[1:]) not in {*versions.values(), *now.values()}:
                fs.delete(s.getPath(), True)

    return merge


def run_available(spark: SparkSession, landing: str, schema: str, path: str) -> None:
    """Merge everything that has landed and isn't merged yet, then stop."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(landing)
    query = stream.writeStream.foreachBatch(merge_batch(f"{path}/state")).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def first_sights(stream: DataFrame, key: str = "job_id_hash", at: str = "arrived_at", within: str = "90 days") -> DataFrame:
    """The stream without keys seen before within a span of time; the state of older ones is dropped."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])
