"""Document fingerprints by spot signatures, in DataFrame functions alone.

A text's words are the runs of letters, marks and digits, in lower case; signs of scripts without spaces are words each. Behind every anchor
the chain of the next ``chain`` content words (not common ones) forms a signature, with the anchor in front; words go by 32-bit
hashes, and the set of the chains' 32-bit hashes is the fingerprint, in increasing order, eight hexadecimal digits each. Anchors are the common words of ``common``, the
start of the text, and, as not all languages are in that list, one content word in ``extra`` (by its hash). Texts without a content word have
the hash of all their words, texts without words have the empty set; equal texts have equal fingerprints.

``likeness`` is the Jaccard similarity of two such sets: 1 for equal ones (also empty), 0 at once where one is empty or the ranges don't
meet. ``similar_texts`` finds all pairs of a threshold: classes of equal sets, partitioned by set length so that only neighbouring
lengths can reach it; in a partition, the rarest signatures of a set (as many as a similar set can't all lack) meet, and a
pair is compared only where its lengths, the places of the shared signature and what is left behind them allow it.

``fingerprints`` compares each document with its own edited text and with the next document. Only ids move for the order of
documents: they are dealt by quantiles of doc_id, and each range takes its last successor from the next one. Texts are shuffled once by
doc_id, and of each the part that its predecessor takes over once more.

Null texts count as empty. Rows without doc_id have no place in the order: they are fingerprinted, all that concerns edited and next
texts is null. Rows that repeat a doc_id share the next document; of several with the next id the one of the smallest text follows. A
single document follows itself. Empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Frequent words of some languages, in alphabetical order.
COMMON = tuple(
    "a al als an and are as at au auf aus be been but by can ce ces con da das de del dem den der des di die do du e ein eine el en es est et for from had has have he her his i ich il in is ist it "
    "la las le les lo los mais mit my na ne nicht no not o of on or os ou par para pas per pour que qui se sein she si sich sie so son su sur te that the their they this to um un una und une uno von "
    "was we were which who will with would y you zu zum zur".split()
)
#: Signs that are words by themselves: Thai, Lao, Myanmar, Khmer, kana and Han; by ranges, as script names are slow to match.
SIGNS = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\x{20000}-\x{3134F}"
WORD = rf"[a-z0-9\u00DF-\u00F6\u00F8-\u00FF\p{{L}}\p{{M}}\p{{N}}&&[^{SIGNS}]]+|[{SIGNS}]"


@dataclass(frozen=True)
class SpotParams:
    """``ranges``: how many ranges of doc_id are told apart at most; each is a task of ids alone."""

    chain: int = 2
    extra: int = 8
    common: tuple[str, ...] = COMMON
    ranges: int = 1024


def with_signatures(rows: DataFrame, text: str, out: str, p: SpotParams = SpotParams()) -> DataFrame:
    """``rows`` and, as ``out``, the sorted distinct 32-bit signatures of the column ``text``. One step a column, so that none is worked out twice."""
    none = F.array().cast("array<int>")
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))
    common = [F.hash(F.lit(w)) for w in p.common]
    word = lambda i: F.get("_words", i)
    start = F.hash(F.lit("^"))

    def of_content(i: Column, k: Column) -> Column:
        """Of the k-th content word, the i-th of all: behind the common words since the content word before, and perhaps that one."""
        before = F.when(k == 0, -1).otherwise(F.get("_content", k - 1))
        own = F.when(k == 0, F.array(start)).when(F.pmod(word(before), F.lit(p.extra)) == 0, F.array(word(before))).otherwise(none)
        chain = [word(i), *(word(F.get("_content", k + c)) for c in range(1, p.chain))]
        spots = F.transform(F.concat(F.slice("_words", before + 2, i - before - 1), own), lambda a: F.hash(a, *chain))
        return F.when(k == 0, F.concat(spots, F.array(F.hash(start, word(i))))).otherwise(spots)

    d = rows.withColumn("_words", F.transform(words, lambda w: F.hash(w)))
    places = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1)).otherwise(none)
    d = d.withColumn("_content", F.filter(places, lambda i: ~word(i).isin(common)))
    d = d.withColumn("_spots", F.sort_array(F.array_distinct(F.flatten(F.transform("_content", of_content)))))
    whole = F.when(F.size("_words") > 0, F.array(F.hash("_words"))).otherwise(none)
    return d.withColumn(out, F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(whole)).drop("_words", "_content", "_spots")


def fingerprint(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda h: F.lower(F.lpad(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sorted sets; sets whose ranges don't meet are not compared."""
    apart = (F.size(a) == 0) | (F.size(b) == 0) | (F.element_at(a, -1) < F.get(b, F.lit(0))) | (F.element_at(b, -1) < F.get(a, F.lit(0)))
    both = F.size(F.array_intersect(a, b))
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when(F.coalesce(apart, F.lit(True)), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _range_of(key: Column, bounds: list[int], wide: int = 32) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``; in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    coarse = F.greatest(upto(F.lit([g[0] for g in groups])) - 1, F.lit(0))
    return coarse * wide + upto(F.get(F.array(*[F.lit(g) for g in groups]), coarse))


def successors(docs: DataFrame, p: SpotParams = SpotParams()) -> DataFrame:
    """doc_id, next_id in circular order of the distinct ids, and taken: how many code points the edited text takes from the next."""
    ids = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4)).cast("int").alias("taken"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / p.ranges for i in range(1, p.ranges)], F.lit(20 * p.ranges))).first()[0]
    bounds = sorted(set(cuts or []))
    ids = ids.withColumn("range", _range_of(F.col("doc_id"), bounds))
    least = {r.range: r.least for r in docs.where(F.col("doc_id").isNotNull()).groupBy(_range_of(F.col("doc_id"), bounds).alias("range")).agg(F.min("doc_id").alias("least")).collect()}
    follow, after = [], min(least.values(), default=0)
    for i in range(len(bounds), -1, -1):
        follow.append(after)
        after = least.get(i, after)
    last = F.get(F.lit(follow[::-1]), F.col("range"))
    order = Window.partitionBy("range").orderBy("doc_id")
    return ids.withColumn("next_id", F.coalesce(F.lead("doc_id").over(order), last)).drop("range")


def fingerprints(spark: SparkSession, docs: DataFrame, p: SpotParams = SpotParams()) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and how like they are to it and to the next document's."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = d.where(F.col("doc_id").isNotNull())  # both joins read one exchange of it; so signatures come behind
    taken = with_signatures(placed.join(successors(d, p).select(F.col("doc_id").alias("before"), F.col("next_id").alias("doc_id"), "taken"), "doc_id"), "text", "signatures", p)
    heads = taken.select(F.col("before").alias("doc_id"), F.struct(F.expr("left(text, taken)").alias("head"), "signatures").alias("next")).groupBy("doc_id").agg(F.min("next").alias("next"))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    both = placed.join(heads, "doc_id").withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next.head", F.lit(1), quarter)))
    both = with_signatures(with_signatures(both, "text", "signatures", p), "edited", "edited_signatures", p)
    # texts without doc_id: no neighbour
    null = with_signatures(d.where(F.col("doc_id").isNull()), "text", "signatures", p).withColumns({"edited": F.lit(None).cast("string"), "edited_signatures": F.lit(None).cast("array<int>"), "next": F.lit(None).cast("struct<head:string,signatures:array<int>>")})
    shown = lambda rows: rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("signatures")).alias("fingerprint"),
        fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"),
        likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        likeness(F.col("signatures"), F.col("next.signatures")).alias("near_next"),
    )
    return shown(both).unionByName(shown(null))


def similar_texts(docs: DataFrame, threshold: float = 0.75, p: SpotParams = SpotParams()) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, class_id; pairs: a, b, likeness >= ``threshold``) of classes with equal, not empty sets; a class has its least doc_id.

    A set of n and one of m signatures reach the threshold only if m >= threshold * n and they share one of their
    first n - ceil(threshold * n) + 1 signatures, rarest first. So each class meets only those of its own length partition
    (lengths by powers of 1 / threshold) or the next longer one, through such signatures. Where two meet at the i-th and j-th place,
    they share at most 1 + min(n - i, m - j) signatures; a pair that can't suffice isn't compared, any other once, exactly.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    signed = with_signatures(d, "text", "signatures", p).where(F.size("signatures") > 0).select("doc_id", "signatures", F.xxhash64("signatures").alias("h"), F.hash("signatures").alias("g"))
    least = signed.groupBy("h", "g").agg(F.min("doc_id").alias("class_id"))
    members = signed.select("doc_id", "h", "g").join(least, ["h", "g"]).select("doc_id", "class_id").distinct()
    sets = signed.join(least, [signed.h == least.h, signed.g == least.g, signed.doc_id == least.class_id]).select("class_id", "signatures").dropDuplicates(["class_id"])
    spots = sets.select("class_id", F.size("signatures").alias("n"), F.explode("signatures").alias("spot"))
    rare = spots.groupBy("spot").agg(F.count("*").alias("df"))
    first = spots.join(rare, "spot").withColumn("place", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "spot")))
    first = first.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & (F.col("df") > 1))
    first = first.withColumn("part", F.floor(F.log("n") / F.lit(-math.log(threshold))))
    x = first.select(F.col("class_id").alias("a"), F.col("n").alias("n"), F.col("place").alias("i"), "spot", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    y = first.select(F.col("class_id").alias("b"), F.col("n").alias("m"), F.col("place").alias("j"), "spot", "part")
    # the first place where two meet: all they share is behind it
    need = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("m")) - 1e-9)
    ordered = (F.col("n") < F.col("m")) | (F.col("n") == F.col("m")) & (F.col("a") < F.col("b"))
    met = x.join(y, ["spot", "part"]).where(ordered & (F.col("n") >= threshold * F.col("m"))).groupBy("a", "b").agg(*[F.min(c).alias(c) for c in ("n", "m", "i", "j")])
    met = met.where(F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) + 1 >= need).select("a", "b")
    left, right = sets.select(F.col("class_id").alias("a"), F.col("signatures").alias("s")), sets.select(F.col("class_id").alias("b"), F.col("signatures").alias("t"))
    pairs = met.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("s"), F.col("t")).alias("likeness")).where(F.col("likeness") >= threshold)
    return members, pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")
