"""Corpus files: JSON lines (plain or gzip), sitemaps, robots rules, a manifest.

Malformed lines, and rows without a URL where one is needed, drop out; a missing file reads as an empty corpus, but
can't be packaged.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.corpus import last_wins

RECORD = "url string, title string, description string, last_modified string, fetched_at timestamp, text string, chunks array<string>"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_corpus(spark: SparkSession, path: str, packaged: str | None = None) -> DataFrame:
    """Records of JSON lines; malformed lines are dropped. The packaged copy is read if there is no ``path``, else nothing."""
    for p in (path, packaged):
        if p and _exists(spark, p):
            return spark.read.schema(RECORD).option("mode", "DROPMALFORMED").json(p)
    return spark.createDataFrame([], RECORD)


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """Records of one file of JSON lines, of a repeated URL the last line's."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line"))
    rows = lines.select(F.from_json("value", RECORD).alias("r"), F.struct("_block", "_line").alias("_at")).select("r.*", "_at").where("url is not null")
    return last_wins(rows, "url", "_at").drop("_at")


def write_corpus(records: DataFrame, path: str, compress: bool = False) -> None:
    """Records in URL order (as people sort, not by code point), range-partitioned, so that the files together are sorted."""
    ordered = records.select(*[c.split()[0] for c in RECORD.split(", ")]).orderBy(F.collate("url", "UNICODE"), "url")
    ordered.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


def _size(spark: SparkSession, path: str) -> int:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def package(spark: SparkSession, path: str, packaged: str) -> dict[str, int]:
    """Write a compressed copy of a corpus; the sizes of both."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    write_corpus(read_corpus(spark, path), packaged, compress=True)
    return {"source_bytes": _size(spark, path), "packaged_bytes": _size(spark, packaged)}


def write_manifest(spark: SparkSession, path: str, counts: DataFrame, **more: object) -> None:
    """One JSON object: the one row of ``counts`` and further values."""
    text = json.dumps(counts.first().asDict() | more, indent=2, default=str)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """place, url, last_modified of the url elements of sitemap files; place: the file's name, then the order in it."""
    raw = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    return raw.select(place.alias("place"), F.trim("loc").alias("url"), F.trim("lastmod").alias("last_modified")).where("url is not null")


def sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """Locations of child sitemaps."""
    return spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path).select(F.trim("loc").alias("url"))


def robots_disallows(text: str) -> list[str]:
    """Prefixes that robots.txt disallows for all agents, in order, once each. A rules file is small: plain Python on the driver."""
    found: dict[str, None] = {}
    ours = False
    for line in text.splitlines():
        name, colon, value = line.partition("#")[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if colon and name == "user-agent":
            ours = value == "*"
        elif colon and name == "disallow" and ours and value.startswith("/"):
            found[value] = None
    return list(found)


def health(passages: DataFrame, pages: DataFrame, languages: int = 0, **flags: bool) -> DataFrame:
    """pages, passages, languages and the given flags: one row."""
    one = pages.agg(F.count("*").alias("pages")).join(F.broadcast(passages.agg(F.count("*").alias("passages"))))
    return one.withColumns({"languages": F.lit(languages), **{k: F.lit(v) for k, v in flags.items()}})
