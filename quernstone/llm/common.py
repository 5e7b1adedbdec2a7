"""Small helpers that the operators share: tables, shared storage, cleanup."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters, for the folds that must not touch other letters.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where none is set, a local session (one machine) gets its own; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise ValueError(f"{master}: set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quernstone-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(spark).rstrip('/')}/quernstone/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what runs inside: 10 000 texts or shingle sets are tens of megabytes, in the JVM and again in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lowest_hashes(rows: DataFrame, key: Column, n: int, *kept: Column) -> DataFrame:
    """``kept`` of the ``n`` distinct keys with the lowest hashes, one row a key (the smallest).

    A first pass estimates the number of keys; the second drops, before any shuffle, all but a slice of the hash range
    that holds about 4n of them. So the one sort sees a few times n short rows, however many rows or copies there are.
    """
    hashed = rows.withColumn("_key", F.xxhash64(key))
    total = hashed.agg(F.approx_count_distinct("_key")).first()[0]
    share = min(1.0, 4 * n / max(1, total))
    slice_ = hashed.where(F.col("_key") <= F.lit(int(share * (2**64 - 1)) - 2**63)) if share < 1 else hashed
    one = slice_.groupBy("_key").agg(F.min(F.struct(*kept)).alias("_row"))
    return one.orderBy("_key").limit(n).select("_row.*")


def join_hot(big: DataFrame, small: DataFrame, key: str, total: int, n: str = "n", how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, which has one row a key and in ``n`` how many rows of ``big`` have it; ``total``: rows of ``big``.

    A key with over a ten-thousandth of the rows would be one hot task. There are at most 10 000 such keys, so their
    rows of ``small`` are broadcast, whatever the size of the tables; all others are shuffled. Both tables are read twice.
    """
    most = max(64, total // 10_000)
    hot = F.broadcast(small.where(F.col(n) > most))
    rest = big.join(hot.select(key), key, "left_anti").join(small.where(F.col(n) <= most), key, how)
    return big.join(hot, key).unionByName(rest)


def most_frequent(counts: DataFrame, n: str, most: int, key: str) -> DataFrame:
    """The rows of ``counts`` with the largest ``n``, about ``most`` of them; of those at the limit a slice of the hash range of ``key``.

    The limit comes from the counts' own distribution in steps of a sixteenth of a power of two (at most some thousand
    rows); so no task has to sort or hold the candidates of all others.
    """
    step = F.floor(F.log2(F.col(n)) * 16)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect()
    left = most
    for r in sorted(sizes, key=lambda r: -r["step"]):
        if r["rows"] > left:
            part = int(left / r["rows"] * 1_000_000)
            return counts.where((step > r["step"]) | ((step == r["step"]) & (F.pmod(F.xxhash64(key), F.lit(1_000_000)) < part)))
        left -= r["rows"]
    return counts


def discard(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and nothing reads any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
