"""URL filter: host rules first, then an empirical-Bayes host reputation. [native: SQL functions only]

Labelled page outcomes are counted per host. The bad rate of a suffix shrinks to the global rate, that of a
registered domain to its suffix's, that of a host to its domain's; each level's prior strength comes from the
spread between its groups (method of moments). A host without labels has its domain's rate, else its suffix's, else
the global one, at the prior's strength. A host is blocked when the lower posterior bound of its bad rate
is above a threshold, so hosts with few labels are not blocked on noise.

Edge cases: a null url, or one without ``://``, has host and path ``''`` and is judged as that (empty) host. A page
without label counts for no outcome. Null ids match no label. Repeated rows give repeated results, an empty table
an empty result. Further columns of the inputs are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.llm.common import LOWER, UPPER, join_hot


@dataclass(frozen=True)
class ReputationParams:
    block_above: float = 0.5  # blocked when the lower bound of the bad rate is above this
    z: float = 1.6449  # one-sided 95 % bound
    min_strength: float = 2.0  # limits of a level's prior strength, in pseudo-pages
    max_strength: float = 1000.0


#: Public suffixes of two labels; all others count as of one.
TWO_LABELS = "ac.jp ac.uk co.id co.il co.in co.jp co.ke co.kr co.nz co.th co.uk co.za com.ar com.au com.br com.cn com.co com.hk com.mx com.my com.ng com.pl com.sg com.tr com.tw com.ua edu.au gov.au gov.uk ne.jp net.au or.jp or.kr org.au org.br org.nz org.uk org.za".split()


def name_parts(host: Column) -> tuple[Column, Column]:
    """Public suffix and registered domain of a host, port and user left aside; an address of digits is its own domain."""
    h = F.regexp_replace(host, r"^[^@]*@|:[0-9]*$", "")
    two = F.substring_index(h, ".", -2)
    address, double = h.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\["), two.isin(TWO_LABELS)
    suffix = F.when(address, "").when(double, two).otherwise(F.substring_index(h, ".", -1))
    return suffix, F.when(address, h).when(double, F.substring_index(h, ".", -3)).otherwise(two)


#: (verdict, host, path prefix)
Rule = tuple[str, str, str]


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z folded) and path of a url."""
    after = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; both null where none fits."""
    text = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    if text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


def reputations(outcomes: DataFrame, every: DataFrame, params: ReputationParams) -> DataFrame:
    """(host, bound): the lower posterior bound of the bad rate of each host of ``every`` (host); null without any outcome.

    ``outcomes``: host, bad (0/1). One small row per host is kept after a partial aggregation.
    """
    p = params
    hosts = outcomes.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("k"))
    suffix, domain = name_parts(F.col("host"))
    hosts = hosts.withColumns({"suffix": suffix, "domain": domain})
    domains = hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))

    def strength(groups: DataFrame, name: str) -> DataFrame:
        """One row: the global mean m and the prior strength of this level."""
        one = groups.agg(F.sum("n").alias("tn"), F.sum("k").alias("tk"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.count("*").alias("g"))
        m = F.col("tk") / F.col("tn")
        between = (F.col("kk") - F.col("tk") * m - (F.col("g") - 1) * m * (1 - m)) / (F.col("tn") - F.col("nn") / F.col("tn"))
        found = F.when((F.col("g") > 1) & (between > 0), m * (1 - m) / between - 1).otherwise(F.lit(p.max_strength))
        return one.select(m.alias("m0"), F.greatest(F.lit(p.min_strength), F.least(F.lit(p.max_strength), found)).alias(name))

    def counted(groups: DataFrame, by: str) -> DataFrame:
        return groups.select(by, F.col("n").alias(f"n_{by}"), F.col("k").alias(f"k_{by}"))

    def shrunk(by: str, strength: str, above: str) -> Column:
        n, k = (F.coalesce(F.col(f"{x}_{by}"), F.lit(0.0)) for x in "nk")
        return (k + F.col(strength) * F.col(above)) / (n + F.col(strength))

    h = every.select("host").distinct().withColumns({"suffix": suffix, "domain": domain})
    for groups, by in ((suffixes, "suffix"), (domains, "domain"), (hosts, "host")):
        h = h.join(counted(groups, by), by, "left")
    for one in (strength(suffixes, "s0"), strength(domains, "s1").select("s1"), strength(hosts, "s2").select("s2")):
        h = h.crossJoin(F.broadcast(one))  # each one row
    h = h.withColumn("ms", shrunk("suffix", "s0", "m0")).withColumn("md", shrunk("domain", "s1", "ms"))
    h = h.select("host", shrunk("host", "s2", "md").alias("mean"), (F.coalesce("n_host", F.lit(0.0)) + F.col("s2")).alias("weight"))
    return h.select("host", (F.col("mean") - p.z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))).alias("bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[Rule], params: ReputationParams = ReputationParams()) -> DataFrame:
    """page_id, host, path, rule, verdict, bound for every row of ``pages`` (page_id, url).

    ``labels``: page_id, bad (0/1 or null). Several labels of a page count as bad if one is.
    """
    host, path = url_parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    found = reputations(p.select("page_id", "host").join(known, "page_id").select("host", "bad"), p, params)
    text, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") > params.block_above, "block").otherwise("allow")
    found = found.join(p.groupBy("host").agg(F.count("*").alias("n")), "host")  # every host of p has a bound, or null
    return join_hot(p, found, "host", p.count()).select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "bound")
