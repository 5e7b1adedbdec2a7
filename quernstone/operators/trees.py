"""Nested catalogues of any depth as rows of dotted keys, without the driver: JSON as VARIANT, unfolded level by level.

Objects are inner nodes, everything else is a leaf: lists stay whole, as JSON. A level is one generator over the nodes that are
still objects, so the number of steps is the depth of the deepest tree (one small count each). Each level's nodes are written to
the shared folder, as the next one and the leaves read them.

Null texts, texts that are no JSON and trees that are no object give no rows; empty objects have no keys; null leaves are kept with a
null value; keys that hold dots are not told apart from nesting.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.sources.stored import new_path, stored


def flat_keys(trees: DataFrame, key: list[str], json: str) -> DataFrame:
    """(key, key_path, value) of every leaf of ``trees`` (key, ``json``)."""
    spark = trees.sparkSession
    text = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.to_json(v)).otherwise(F.try_variant_get(v, "$", "string"))
    inner = F.schema_of_variant("node").startswith("OBJECT")
    level = trees.select(*key, F.lit("").alias("above"), F.try_parse_json(json).alias("node")).where(F.col("node").isNotNull() & inner)
    leaves = []
    while True:
        below = level.lateralJoin(spark.tvf.variant_explode(F.col("node").outer()))
        path = F.concat("above", F.when(F.col("above") == "", "").otherwise("."), "key")
        below = stored(below.select(*[level[c] for c in key], path.alias("above"), F.col("value").alias("node"), F.schema_of_variant("value").startswith("OBJECT").alias("inner")), new_path(spark, "level"))
        leaves.append(below.where("not inner").select(*key, F.col("above").alias("key_path"), text(F.col("node")).alias("value")))
        level = below.where("inner").select(*key, "above", "node")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
