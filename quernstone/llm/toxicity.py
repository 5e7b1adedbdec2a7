"""Toxicity behind a noisy channel.

Learnt from all labelled rows of the training folds and no others: which words and
word beginnings or stems go with the label (candidates by z-score, weights by ridge logistic regression, so that words that
merely keep company with others get little), and a character trigram model of the language. Scoring reads a token
as the output of a noisy channel: leetspeak substitutes letters, punctuation and spacing are put in, letters are
repeated. A Viterbi beam over the character lattice restores the likeliest words under the character model and the
channel's costs; the features of the restored text, not of the disguise, are scored. Long tokens, and words whose
letters are written apart, are read to their end: feature words are looked for inside the lattice itself, where only
the best path to each state is kept.

Plain tokens, nearly all, need no decoding and are looked up; each task remembers a bounded number of tokens. Labels are
broadcast up to a bound (``broadcast_labels``); beyond it the texts of the training folds are shuffled to them once. The regression is
Spark's, on feature sets with their numbers, so the driver holds the model alone.

Edge cases: null and empty texts get the score of a text without any feature; with no labelled training row every
score is 0.5; labels with a null toxic or doc_id are ignored, several labels of a doc_id count as toxic if one is;
repeated rows are each scored; rows with a null doc_id are scored and are not held out; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.batches import by_portions, portions
from quernstone.llm.common import discard, materialize, most_frequent


@dataclass(frozen=True)
class ToxicityParams:
    folds: int = 3  # crc32(doc_id) mod folds
    held_out: int = 1  # = this is held out
    broadcast_labels: int = 500_000  # labelled training rows above which they are joined by a shuffle
    features: int = 4_000  # words and word beginnings at most
    min_z: float = 4.0
    ridge: float = 0.1
    min_rate: float = 0.5  # of documents with a feature, those labelled toxic
    trigrams: int = 100_000  # of the language model, the most frequent; rarer ones have the probability of unseen ones
    apart_letters: int = 4  # shorter words are not looked for in letters written apart, where almost any of two or three turn up
    threshold: float = 0.7
    beam: int = 24
    margin: float = 9.0  # how far below the best reading (nats) another may be


#: What a written character may stand for: fixed values.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l"}
EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "«»“”„‘’…–—¿¡"
SOFT = "".join(c for c in EDGE if c not in LEET)  # stands for no letter
#: Letters written apart: single characters with separators between.
APART = re.compile(r"(?<!\S)(?:[^\W_][ .*_-]{1,2}|[@$!|][ .*_-]{1,2}){2,}(?:[^\W_]|[@$!|])(?!\S)")
#: What each of them begins with: a single character, separators, a single character, a separator.
APART_START = re.compile(r"[ .*_-](?<=(?<!\S)[\w@$!|].)[ .*_-]?[\w@$!|][ .*_-]")
DOUBLE, TRIPLE = re.compile(r"(.)\1"), re.compile(r"(.)\1\1")
#: Between words that punctuation glues together: what stands for no letter.
GLUE = re.compile("(?:_|[^\\w" + re.escape("".join(c for c in LEET if not c.isalnum())) + "])+")
LONG = 40  # longer tokens are read in the lattice
PLAIN, START, STOP = "", "^", "$"


def collapsed(word: str) -> str:
    return "".join(c for c, _ in groupby(word))


def feature_names(word: str) -> list[str]:
    """A word is a feature, so are its first four and five letters, and its stems: four to seven letters before an ending of at most five."""
    size = len(word)
    if size < 5:
        return [word]
    out = [word, word[:4] + "*"]
    if size > 5:
        out.append(word[:5] + "*")
    for n in (4, 5, 6, 7):
        if n < size <= n + 5:
            out.append(word[:n] + "+*")
    return out


def plain_words(text: str) -> set[str]:
    return {w for t in set(text.lower().split()) if (w := t.strip(EDGE))}


@dataclass
class Restorer:
    """Viterbi beam over the readings of a written token."""

    trigram: dict[str, float]  # log probabilities; the empty key is the floor
    beam: int
    cost: dict[str, float] = field(default_factory=lambda: {"leet": 1.5, "drop": 1.5, "repeat": 0.7, "keep": 5.0})

    def step(self, two: str, c: str) -> float:
        return self.trigram.get(two + c, self.trigram.get("", -8.0))

    def options(self, c: str, before: str) -> list[tuple[str, float]]:
        """What a written character may stand for after the one before it, with costs."""
        out: list[tuple[str, float]] = []
        if c.isalpha():
            out.append((c, 0.0))
        else:
            out += [(x, self.cost["leet"]) for x in LEET.get(c, "")]
            out.append(("", self.cost["keep"] if c.isdigit() else self.cost["drop"]))
        if c == before:
            out.append(("", self.cost["repeat"]))
        return out

    def readings(self, token: str) -> list[tuple[float, str]]:
        """(log probability, restored word), best first."""
        states: dict[str, float] = {"": 0.0}
        before = ""
        for c in token:
            options = self.options(c, before)
            nxt: dict[str, float] = {}
            for word, p in states.items():
                two = (START * 2 + word)[-2:]
                for x, cost in options:
                    q = p - cost + (self.step(two, x) if x else 0.0)
                    if q > nxt.get(word + x, -1e300):
                        nxt[word + x] = q
            states = dict(sorted(nxt.items(), key=lambda s: (-s[1], s[0]))[: self.beam])
            before = c
        ended = [(p + self.step((START * 2 + w)[-2:], STOP), w) for w, p in states.items() if w]
        return sorted(ended, key=lambda s: (-s[0], s[1]))

    def inside(self, written: str, words: dict[str, str], starts: set[str], margin: float, whole: bool) -> set[str]:
        """The words (spelling: word) that readings within ``margin`` of the best spell: as a whole, or anywhere in it.

        ``starts``: the spellings' beginnings. Doubled letters may stand for one.
        """
        every: dict[str, float] = {START * 2: 0.0}  # last two letters: best path
        partly: dict[tuple[str, str], float] = {(START * 2, ""): 0.0} if whole else {}  # and the beginning spelt so far
        found: set[str] = set()
        before = ""
        for c in written:
            options = self.options(c, before)
            before = c
            now: dict[str, float] = {}
            spelt: dict[tuple[str, str], float] = {}
            paths = [(two, None if whole else "", p) for two, p in every.items()] + [(two, w, p) for (two, w), p in partly.items()]
            for i, (two, w, p) in enumerate(paths):
                for x, cost in options:
                    q = p - cost + (self.step(two, x) if x else 0.0)
                    end = (two + x)[-2:]
                    if i < len(every) and q > now.get(end, -1e300):
                        now[end] = q
                    if w is None or (not w and not x and not whole):
                        continue
                    for v in (w + x, w) if w[-1:] == x else (w + x,):
                        if v in starts and q > spelt.get((end, v), -1e300):
                            spelt[end, v] = q
            best = max(now.values())
            every = {k: p - best for k, p in now.items()}
            partly = {k: p - best for k, p in spelt.items()}
            if whole and not partly:
                return found
            if not whole:
                found.update(words[w] for (_, w), p in partly.items() if p >= -margin and w in words)
        if whole:
            best = max(p + self.step(two, STOP) for two, p in every.items())
            found.update(words[w] for (two, w), p in partly.items() if w in words and p + self.step(two, STOP) >= best - margin)
        return found


def disguised(core: str, token: str) -> bool:
    """Whether a token (and it without its edges) may be a word in disguise."""
    if core == token and core.isalpha():
        return len(core) > 1 and bool(TRIPLE.search(core))
    if sum(c.isalpha() for c in core) < 2:
        return False
    if not core.isalpha() or TRIPLE.search(core):
        return True
    at = token.find(core)
    left, right = token[:at], token[at + len(core) :]
    return any(len(set(x)) == 1 and len(x) == 1 and x in LEET for x in (left, right))


@dataclass
class Model:
    """All that scoring needs; its size is bounded by the parameters."""

    weights: dict[str, float]
    bias: float
    trigram: dict[str, float]
    params: ToxicityParams

    def __post_init__(self) -> None:
        self.restore = Restorer(self.trigram, self.params.beam)
        self.squeezed: dict[str, str] = {collapsed(w): w for w in self.weights if not w.endswith("*")}
        self.long = {w: w for w in self.weights if not w.endswith("*") and len(w) >= self.params.apart_letters}
        self.spelt = self.squeezed | {w: w for w in self.squeezed.values()}
        self.long_starts, self.starts = ({w[:n] for w in x for n in range(len(w) + 1)} for x in (self.long, self.spelt))
        heads: dict[str, set[str]] = {}  # what all features of a word are or begin with, by its first letters
        for f in self.weights:
            heads.setdefault(f[:4], set()).add(f.removesuffix("*").removesuffix("+") if f.endswith("*") else f)
        self.heads = {head: tuple(sorted(starts)) for head, starts in heads.items()}
        self.seen: dict[str, tuple[str, ...]] = {}  # features of tokens
        self.plain: set[str] = set()  # words that have none, whatever punctuation is around them

    def known(self, word: str) -> tuple[str, ...]:
        if not word.startswith(self.heads.get(word[:4], ())):
            return ()
        return tuple(f for f in feature_names(word) if f in self.weights)

    def featureless(self, word: str) -> bool:
        """Whether letters have no feature, in whatever punctuation of ``SOFT``: nothing is to be restored or cut there."""
        if word.startswith(self.heads.get(word[:4], ())):
            return False
        return not DOUBLE.search(word) or (not TRIPLE.search(word) and collapsed(word) not in self.squeezed)

    def of_token(self, token: str) -> tuple[str, ...]:
        """Features of a written token, restored where it may be a disguise."""
        token = token.lower()
        core = token.strip(EDGE)
        if not core:
            return ()
        found = self.known(core) if core.isalpha() else ()
        if found:
            return found
        if disguised(core, token):
            own = token if len(token) - len(core) <= 2 else core
            if len(own) > LONG:
                for x in dict.fromkeys((own, core)):
                    if words := self.restore.inside(x, self.spelt, self.starts, self.params.margin, True):
                        return tuple(dict.fromkeys(f for w in sorted(words) for f in self.known(w)))
            best = None
            for p, w in chain(self.restore.readings(own), self.restore.readings(core) if own != core else ()) if len(own) <= LONG else ():
                best = p if best is None else best
                if p >= best - self.params.margin and (w in self.weights or collapsed(w) in self.squeezed):
                    return self.known(w if w in self.weights else self.squeezed[collapsed(w)])
        if core.isalpha():  # nothing glues parts together
            return self.known(self.squeezed[short]) if DOUBLE.search(core) and (short := collapsed(core)) in self.squeezed else ()
        return self.of_parts(core)

    def of_parts(self, core: str) -> tuple[str, ...]:
        """Features of words that punctuation glues together."""
        parts = [x for x in dict.fromkeys(GLUE.split(core)) if x]
        return tuple(dict.fromkeys(f for x in parts for f in self.of_token(x))) if len(parts) > 1 else ()

    def of_apart(self, text: str) -> Iterator[str]:
        """Features of words whose letters are written apart."""
        for m in APART.finditer(text):
            letters = re.sub(r"[ .*_-]+", "", m.group().lower())
            for w in sorted(self.restore.inside(letters, self.long, self.long_starts, self.params.margin, False)):
                yield from self.known(w)

    def score(self, text: str | None) -> float:
        found: set[str] = set()
        if text:
            plain, seen = self.plain, self.seen
            if len(plain) > 70_000:
                plain.clear()
            if len(seen) > 30_000:
                seen.clear()
            for t in set(text.lower().split()):
                if (word := t.strip(SOFT)) in plain:
                    continue
                f = seen.get(t)
                if f is None:
                    if word.isalpha() and self.featureless(word):
                        plain.add(word)
                        continue
                    f = seen[t] = self.of_token(t)
                if f:
                    found.update(f)
            if APART_START.search(text):
                found.update(self.of_apart(text))
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-max(-40.0, min(40.0, z)))))


# --- training ---------------------------------------------------------------------------------------------------


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, params: ToxicityParams) -> DataFrame:
    """text, toxic of all labelled rows of the training folds."""
    trains = lambda df: df.where(fold(F.col("doc_id"), params.folds) != params.held_out)
    each = trains(labels.where("doc_id is not null and toxic is not null")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = trains(docs.select("doc_id", "text").where("text is not null"))
    if each.count() <= params.broadcast_labels:
        return texts.join(F.broadcast(each), "doc_id").select("text", "toxic")
    return materialize(docs.sparkSession, texts.join(each, "doc_id").select("text", "toxic"), "training")


class _Remembered(dict):
    """What ``make`` makes of a word, for a bounded number of words; those met again meanwhile stay."""

    def __init__(self, make) -> None:
        self.make, self.before = make, {}

    def __missing__(self, word: str):
        if len(self) > 15_000:
            self.before = dict(self)
            self.clear()
        made = self.before.get(word)
        self[word] = made = self.make(word) if made is None else made
        return made


def count_words(rows: DataFrame) -> DataFrame:
    """(key, is_gram, n, t): texts with a feature and toxic ones among them; trigram counts over distinct words of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        t: Counter = Counter()
        said: Counter = Counter()  # texts with a word: trigrams are counted once a word
        names_of = _Remembered(feature_names)

        def out() -> Iterator[pa.RecordBatch]:
            grams: Counter = Counter()
            for w, times in said.items():
                w = START * 2 + w + STOP
                for i in range(len(w) - 2):
                    grams[w[i : i + 3]] += times
            for is_gram, some in ((False, n), (True, grams)):
                yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.string()), pa.array([is_gram] * len(some), pa.bool_()), pa.array(list(some.values()), pa.int64()), pa.array([0 if is_gram else t[k] for k in some], pa.int64())], ["key", "is_gram", "n", "t"])
            n.clear(), t.clear(), said.clear()

        for b in batches:
            for text, toxic in zip(chain.from_iterable(portions(b.column("text"))), b.column("toxic").to_pylist(), strict=True):
                words = plain_words(text)
                names = set(chain.from_iterable(map(names_of.__getitem__, words)))
                n.update(names)
                if toxic:
                    t.update(names)
                said.update(w for w in words if w.isalpha())
                if len(n) > 200_000:
                    yield from out()
        yield from out()

    counted = rows.mapInArrow(run, "key string, is_gram boolean, n long, t long")
    return counted.groupBy("key", "is_gram").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))


def trigram_model(grams: pd.DataFrame) -> dict[str, float]:
    context: Counter = Counter()
    for k, n in zip(grams["key"], grams["n"], strict=True):
        context[k[:2]] += n
    model = {k: log((n + 0.05) / (context[k[:2]] + 5.0)) for k, n in zip(grams["key"], grams["n"], strict=True)}
    model[""] = log(0.05 / 25)
    return model


def logistic(data: DataFrame, m: int, ridge: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on 0/1 rows of ``m`` features (have: their numbers; toxic), each as often as ``count`` says."""
    vector = F.udf(lambda have: Vectors.sparse(m, have, [1.0] * len(have)), VectorUDT())
    total, toxic = data.agg(F.sum("count"), F.sum(F.when(F.col("toxic") > 0, F.col("count")).otherwise(0))).first()
    if not m or toxic in (0, total):
        return np.zeros(m), log((toxic + 0.5) / (total - toxic + 0.5))
    rows = data.select(vector("have").alias("features"), (F.col("toxic") > 0).cast("double").alias("label"), F.col("count").cast("double").alias("weight"))
    # Spark's loss is a mean, the ridge is that of the sum
    found = LogisticRegression(weightCol="weight", regParam=ridge / total, standardization=False, maxIter=300, tol=1e-9).fit(rows)
    return found.coefficients.toArray(), float(found.intercept)


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> Model:
    rows = training_rows(docs, labels, params)
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not total:
        return Model({}, 0.0, {"": -8.0}, params)
    rate = (toxic + 0.5) / (total + 1)
    counted = materialize(docs.sparkSession, count_words(rows), "words")
    grams = most_frequent(counted.where("is_gram").where("n >= 3"), "n", params.trigrams, "key").toArrow().to_pandas().sort_values("key")
    z = (F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    found = counted.where(~F.col("is_gram")).where((F.col("t") >= params.min_rate * F.col("n")) & (F.col("n") >= 3)).withColumn("z", z)
    names = [r.key for r in found.where(F.col("z") >= params.min_z).orderBy(F.desc("z"), "key").limit(params.features).collect()]
    discard(docs.sparkSession, counted)
    at = {f: i for i, f in enumerate(names)}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = _Remembered(lambda w: tuple(at[f] for f in feature_names(w) if f in at))
        for b in batches:
            have = [sorted(set(chain.from_iterable(map(numbers.__getitem__, plain_words(t))))) for t in b["text"]]
            yield pd.DataFrame({"have": have, "toxic": b["toxic"].astype(int)})

    # equal rows of features count with their number: copies of a labelled text do not add to the work
    data = materialize(docs.sparkSession, rows.mapInPandas(present, "have array<int>, toxic int").groupBy("have", "toxic").count(), "features")
    w, b = logistic(data, len(names), params.ridge)
    for done in (data, rows):
        discard(docs.sparkSession, done)
    return Model({f: float(w[i]) for f, i in at.items() if abs(w[i]) > 1e-4}, b, trigram_model(grams), params)


def score_column(spark: SparkSession, text: Column, model: Model) -> Column:
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        yield from by_portions(lambda texts: list(map(m.score, texts)), pa.float64())(batches)

    return F.arrow_udf(run, "double")(text)


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text); ``labels``: doc_id, toxic."""
    d = docs.select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id"), params.folds) == params.held_out, F.lit(False))
    scored = d.select("doc_id", held.alias("held_out"), score_column(spark, F.col("text"), fit(d, labels, params)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= params.threshold).cast("int"))


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they were."""
    model = fit(docs, labels, params)
    return docs.where(score_column(spark, F.col("text"), model) < params.threshold)
