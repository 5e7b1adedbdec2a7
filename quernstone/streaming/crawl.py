"""A crawl as a stream: what is pending is planned as files, each micro-batch fetches one and stores what it got.

Under the run's folder: ``frontier`` (what to fetch, a file a step), ``records`` (pages by micro-batch), ``outcomes`` (url, error by micro-batch),
``progress`` (the stream's checkpoint). A micro-batch writes under its own number and overwrites what an attempt that broke off had left, so a run
that is killed and started again fetches no finished step twice and counts no page twice. The corpus is the cached one with the records of all
micro-batches laid over it; ``compact`` writes that as one table.

A page fails if it can't be read (see ``fetch_errors``), is missing from what was fetched, or has too little content. Null URLs are
not planned; an empty plan makes no step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.corpus import crawl_counts, fetch_errors, last_wins, merge, pending
from quernstone.sources.stored import present

OUTCOMES = "url string, error string"
Step = Callable[[DataFrame], DataFrame]


def plan(found: DataFrame, cached: DataFrame, path: str, limit: int | None = None, step: int = 1000, refresh: bool = False) -> DataFrame:
    """Write the frontier: the pages of ``found`` (url, last_modified) to fetch, in the order of their URLs, the first ``limit`` of them. A plan that is there stays."""
    spark, at = found.sparkSession, f"{path}/frontier"
    if not present(spark, at):
        todo = pending(found, cached, refresh).where("url is not null").select("url", "last_modified").orderBy(F.collate("url", "UNICODE"), "url")
        (todo if limit is None else todo.limit(limit)).write.option("maxRecordsPerFile", step).parquet(at)
    return spark.read.schema("url string, last_modified string").parquet(at)


def run(spark: SparkSession, path: str, fetch: Step, read: Step | None = None, steps: int | None = None) -> None:
    """Work through the frontier. ``fetch``: (url, last_modified) to (url, status, content_type, html); ``read``: (url, last_modified, html) to
    records, of those pages only that have enough content. ``steps``: stop after about so many (a run is resumed by running it again)."""
    frontier = spark.readStream.schema("url string, last_modified string").option("maxFilesPerTrigger", 1).parquet(f"{path}/frontier")

    def store(batch: DataFrame, number: int) -> None:
        asked = batch.persist()  # one step's addresses: the source is not listed twice
        pages = fetch_errors(asked.join(fetch(asked).select("url", "status", "content_type", "html"), "url", "left"))
        pages.write.mode("overwrite").parquet(f"{path}/fetched/batch={number}")  # what is fetched once is not fetched again below
        pages = asked.sparkSession.read.schema(pages.schema).parquet(f"{path}/fetched/batch={number}")
        good = pages.where("error is null").select("url", "last_modified", "html")
        records = good if read is None else read(good)
        records.write.mode("overwrite").parquet(f"{path}/records/batch={number}")
        kept = asked.sparkSession.read.schema(records.schema).parquet(f"{path}/records/batch={number}").select("url", F.lit(True).alias("_kept"))
        judged = pages.join(kept, "url", "left").select("url", F.when(F.col("error").isNull() & F.col("_kept").isNull(), "empty page").otherwise(F.col("error")).alias("error"))
        judged.write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")
        asked.unpersist()

    writer = frontier.writeStream.foreachBatch(store).option("checkpointLocation", f"{path}/progress")
    if steps is None:
        writer.trigger(availableNow=True).start().awaitTermination()
        return
    query = writer.start()
    while query.isActive and not ((p := query.lastProgress) and p["batchId"] + 1 >= steps):
        query.awaitTermination(1)
    query.stop()


def _all(spark: SparkSession, path: str, schema) -> DataFrame:  # noqa: ANN001
    """Rows of all micro-batches with their number, or none where none was stored."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema).withColumn("batch", F.lit(0))
    return spark.read.schema(spark.createDataFrame([], schema).withColumn("batch", F.lit(0)).schema).option("basePath", path).parquet(path)


def corpus(found: DataFrame, cached: DataFrame, path: str) -> DataFrame:
    """The corpus as it is now: records over ``cached`` (same columns), approved pages (``found``) only."""
    records = _all(found.sparkSession, f"{path}/records", cached.schema)
    return merge(cached, last_wins(records, "url", "batch").select(*cached.columns), found)


def counts(spark: SparkSession, path: str) -> DataFrame:
    """completed, failed, total of the run so far."""
    return crawl_counts(_all(spark, f"{path}/outcomes", OUTCOMES))


def compact(found: DataFrame, cached: DataFrame, path: str, version: str) -> DataFrame:
    """The corpus as one table at ``version``."""
    now = corpus(found, cached, path)
    now.write.parquet(version)
    return found.sparkSession.read.schema(now.schema).parquet(version)
