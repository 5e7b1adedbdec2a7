"""Whole discovery of a site's pages: a sitemap index, its children in order, robots rules, normal URLs, a manifest.

The data source ``sitemap`` plans one partition for each child of the index (or each file of a folder that fits a pattern, by name) and
keeps the order of files and of entries, so that of a repeated URL the last one wins across files. Children are read where the index
says, or, with the option ``base``, from that folder by the last part of their address. Any store that Arrow's file systems know will do.

An entry without an address drops out, an empty date is null, text outside entries is not read; a child that is missing fails the
read, as half a site must not look like a whole one. An index without children gives an empty result.
"""

from __future__ import annotations

import fnmatch
import html
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quernstone.config import UrlRules
from quernstone.operators.corpus import discover
from quernstone.sources.corpus_io import robots_disallows
from quernstone.sources.stored import new_path

ENTRIES = "file long, entry long, url string, last_modified string"


def _file(uri: str) -> tuple[object, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", uri) else (fs.LocalFileSystem(), uri)


def _read(uri: str) -> str:
    store, path = _file(uri)
    with store.open_input_stream(path) as f:  # a name that ends in .gz is unpacked
        return f.read().decode("utf-8", "replace")


def elements(xml: str, name: str) -> Iterator[str]:
    """What stands in each element of that name, in order. Comments don't count."""
    plain = re.sub(r"<!--.*?-->", "", xml, flags=re.S)
    for m in re.finditer(rf"<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", plain, re.S | re.I):
        yield m[1]


def text_of(xml: str) -> str:
    """The text of an element: tags gone, CDATA as it stands, references decoded."""
    parts = re.split(r"<!\[CDATA\[(.*?)\]\]>", xml, flags=re.S)
    return "".join(p if i % 2 else html.unescape(re.sub(r"<[^>]*>", "", p)) for i, p in enumerate(parts)).strip()


class _Child(InputPartition):
    def __init__(self, number: int, uri: str):
        self.number, self.uri = number, uri


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        if "folder" in self.options:
            from pyarrow import fs

            store, path = _file(self.options["folder"])
            names = sorted(i.base_name for i in store.get_file_info(fs.FileSelector(path)) if i.is_file)
            children = [f"{self.options['folder'].rstrip('/')}/{n}" for n in names if fnmatch.fnmatch(n, self.options.get("pattern", "*.xml"))]
        else:
            children = [u for u in map(text_of, elements(_read(self.options["path"]), "loc")) if u]
            if "base" in self.options:
                children = [f"{self.options['base'].rstrip('/')}/{u.rstrip('/').rpartition('/')[2]}" for u in children]
        return [_Child(i, u) for i, u in enumerate(children)] or [_Child(-1, "")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.number < 0:
            return
        for at, entry in enumerate(elements(_read(partition.uri), "url")):
            url, date = (next(map(text_of, elements(entry, name)), "") for name in ("loc", "lastmod"))
            if url:
                yield partition.number, at, url, date or None


class SitemapSource(DataSource):
    """Options: path (of an index) and perhaps base, or folder and perhaps pattern."""

    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options))


def site_entries(spark: SparkSession, **options: str) -> DataFrame:
    """place, url, last_modified of all entries; place orders them by file, then within it."""
    spark.dataSource.register(SitemapSource)
    return spark.read.format("sitemap").options(**options).load().select(F.struct("file", "entry").alias("place"), "url", "last_modified")


def discover_site(spark: SparkSession, robots: str, rules: UrlRules = UrlRules(), **options: str) -> DataFrame:
    """url, last_modified of the relevant pages, in the order of their URLs; ``robots``: the text of robots.txt."""
    return discover(site_entries(spark, **options), rules, tuple(robots_disallows(robots))).orderBy(F.collate("url", "UNICODE"), "url")


def write_manifest(pages: DataFrame, path: str, **more: object) -> None:
    """One JSON document: ``more``, pageCount, and pages in the order of their URLs.

    Tasks write the pages as lines; the files are then joined, byte by byte in the store's own buffers. Nothing is collected.
    """
    spark = pages.sparkSession
    rows = pages.withColumnRenamed("last_modified", "lastModified")
    line = F.concat(F.lit(",    "), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
    parts = new_path(spark, "manifest")
    rows.orderBy(F.collate("url", "UNICODE"), "url").select(line.alias("value")).write.text(parts)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    here = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    store, target = here(parts).getFileSystem(conf), here(path).getFileSystem(conf)
    head = json.dumps(more | {"pageCount": spark.read.text(parts).count()}, indent=2, default=str)
    out = target.create(here(path), True)
    try:
        out.write(bytearray((head[:-2] + ',\n  "pages": [\n').encode()))
        first = True
        for f in sorted(str(s.getPath()) for s in store.listStatus(here(parts)) if s.getPath().getName().startswith("part-") and s.getLen()):
            data = store.open(here(f))
            if first:
                data.read()  # no comma before the first page
                first = False
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, 65536, False)
            data.close()
        out.write(bytearray(b"  ]\n}\n"))
    finally:
        out.close()
    store.delete(here(parts), True)
