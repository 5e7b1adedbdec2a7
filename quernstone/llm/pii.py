"""Personal data by weak supervision.

Candidate spans come from wide patterns: the four base kinds, and written-out emails, plain phone numbers, names,
secrets (known forms, values that a word such as password or token is given, random-looking tokens), social security
numbers, street addresses, IBANs and IPv6 addresses. Independent labelers (pattern shape, checksum or entropy,
gazetteer, context words, neighbours) vote +1, 0 or -1 on each. Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is, without labels, and gives each pattern a posterior; a logistic span classifier is
trained on those posteriors and decides on every candidate. Base spans (the four fixed patterns)
always stay; a further candidate that overlaps one is none.

The corpus is read twice: once for the vote-pattern counts (at most kinds x 3^labelers rows, whatever the
corpus), once to decide. Nothing else moves between tasks.

Edge cases: a null or empty text has no spans (its base_sha256 is that of the empty string); repeated rows are
each judged; nulls and further columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.batches import by_portions

#: Output order of the kinds; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "name", "secret", "ssn", "address", "iban")
LABELERS = ("shape", "checksum", "gazetteer", "context", "neighbours")
EMAIL_KIND, IP_KIND, CARD_KIND, PHONE_KIND, NAME_KIND, SECRET_KIND, SSN_KIND, ADDRESS_KIND, IBAN_KIND = range(len(KINDS))

EMAIL_TAIL = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Patterns of the further candidates. They are wide on purpose: the labelers and what is learnt from them decide.
EMAIL_WORDS = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}) ?[A-Za-z0-9-]+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\.) ?[A-Za-z0-9-]+)+", re.I)
PHONE_PLAIN = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-]|\.[0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET_WORDS = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "api key", "access_key", "access-key", "access key", "private_key", "private-key", "credential", "auth")
ASSIGNED = re.compile(rf"(?:{'|'.join(SECRET_WORDS)})[A-Za-z0-9_]*[\"']?(?: ?(?::=|=>|[:=]) ?[\"'`]?| is [\"'`])([^\s\"'`,;<>]{{6,}})", re.I)
KNOWN_SECRET = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36,}|xox[abp]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:\s+[A-Za-z0-9+/=]+)+\s*-----END [A-Z ]*PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{32,})*)")
RANDOM = re.compile(r"(?<![A-Za-z0-9_/+=.-])(?=[A-Za-z_/+=-]*[0-9])(?=[0-9_/+=-]*[A-Za-z])[A-Za-z0-9_/+=-]{24,}(?![A-Za-z0-9_/+=.-])")
TITLED = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? ([A-Z][a-z]+(?: [A-Z][a-z]+)?)")
CAPITAL = re.compile(r"\b[A-Z][a-z]+(?= [A-Z][a-z])")
NEXT_NAMES = re.compile(r" [A-Z][a-z]+(?: [A-Z][a-z]+)?")
ADDRESS = re.compile(r"(?<![0-9.,-])[0-9]{1,5}[a-z]? (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Square|Way)\b|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|gasse|weg|platz|allee) [0-9]{1,4}[a-z]?\b")
IP6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:.])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")

#: Gazetteers: common given and family names, values that only stand for a secret, words that speak for or against a kind nearby.
GIVEN = frozenset("anna maria james john robert michael william david richard thomas mary patricia jennifer linda elizabeth barbara susan peter hans karl pierre jean marie juan jose carmen luis carlos ana laura paul mark daniel sarah emma jessica karen nancy lisa george kenneth steven edward brian ronald anthony kevin jason matthew gary timothy sophie claire julien nicolas francois camille klaus jürgen stefan monika sabine petra ingrid wolfgang miguel antonio manuel pedro lucia elena isabel sofia javier diego".split())
FAMILY = frozenset("smith johnson williams brown jones miller davis wilson anderson taylor thomas moore martin jackson thompson white lopez lee garcia martinez rodriguez hernandez gonzalez perez sanchez ramirez clark lewis walker hall young king wright müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann bernard dubois durand moreau laurent lefebvre michel roux fernandez gomez diaz torres ruiz".split())
PLACEHOLDER = re.compile(r"(?:your|my|the|some|example|sample|changeme|placeholder|redacted|required|optional|none|null|true|false|string|undefined|invalid|missing|x{4,}|\*{3,}|\.{3,}|[$%{<]).*", re.I)
FOR = {
    "email": {"email", "mail", "contact", "write", "kontakt", "courriel", "correo"},
    "ip": {"ip", "host", "server", "address", "addr", "client", "login"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "telefono"},
    "name": {"dear", "regards", "sincerely", "signed", "patient", "employee", "customer", "name", "sehr", "cher", "estimado", "by", "born"},
    "secret": {"password", "passwd", "pwd", "passphrase", "key", "token", "secret", "login", "api", "auth", "credential", "credentials", "bearer"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
    "address": {"address", "lives", "live", "resides", "home", "mail", "ship", "deliver", "visit", "wohnt", "adresse", "at"},
    "iban": {"iban", "account", "bank", "transfer", "konto", "compte", "cuenta"},
}
AGAINST = frozenset("version release build section chapter isbn figure table page total price item sku commit sha checksum digest revision uuid hash md5 etag".split())
#: After a capitalised pair: it names a place, firm or thing.
NO_PERSON = frozenset("street avenue road university college school hospital prize award inc ltd gmbh company bridge park river lake museum theatre station airport".split())


@dataclass(frozen=True)
class PiiParams:
    context_chars: int = 40
    iterations: int = 40
    accept: float = 0.5


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d - 9 if (d := 2 * int(c)) > 9 else d for c in digits[-2::-2])) % 10 == 0


def run_start(text: str, low: int, at: int) -> int:
    """Start of the run of local-part characters that ends before ``at``."""
    while at > low and (text[at - 1] in "._%+-" or (text[at - 1].isascii() and text[at - 1].isalnum())):
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the four fixed kinds; failing matches are dropped, not retried."""
    found, low = [], 0
    at = text.find("@")
    while at >= 0:
        head = run_start(text, low, at)
        tail = EMAIL_TAIL.match(text, at + 1) if head < at else None
        if tail:
            found.append((0, head, tail.end()))
            low = tail.end()
        at = text.find("@", max(at + 1, low))
    if not any(c in text for c in "0123456789"):
        return found
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := re.sub("[ -]", "", m.group())) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, is base), base spans first."""
    found = [(*s, True) for s in base_spans(text)]
    more = []
    digits = any(c in text for c in "0123456789")
    if re.search(r"[(\[{]at[)\]}]", text, re.I):
        more += [(EMAIL_KIND, m.start(), m.end()) for m in EMAIL_WORDS.finditer(text)]
    if digits:
        more += [(PHONE_KIND, m.start(), m.end()) for m in PHONE_PLAIN.finditer(text)]
        more += [(SSN_KIND, m.start(), m.end()) for m in SSN.finditer(text)]
        more += [(ADDRESS_KIND, m.start(), m.end()) for m in ADDRESS.finditer(text)]
        more += [(IBAN_KIND, m.start(), m.end()) for m in IBAN.finditer(text)]
        if ":" in text:
            more += [(IP_KIND, m.start(), m.end()) for m in IP6.finditer(text) if m.group().count(":") >= 4 or "::" in m.group()]
    low = text.lower()
    if any(w in low for w in SECRET_WORDS):
        more += [(SECRET_KIND, m.start(1), m.end(1)) for m in ASSIGNED.finditer(text)]
    if any(w in text for w in ("AKIA", "gh", "xox", "eyJ", "-----BEGIN")):
        more += [(SECRET_KIND, m.start(), m.end()) for m in KNOWN_SECRET.finditer(text)]
    if digits:
        more += [(SECRET_KIND, m.start(), m.end()) for m in RANDOM.finditer(text)]
    more += [(NAME_KIND, m.start(1), m.end(1)) for m in TITLED.finditer(text)]
    for m in CAPITAL.finditer(text):
        if m.group().lower() in GIVEN:
            more.append((NAME_KIND, m.start(), NEXT_NAMES.match(text, m.end()).end()))
    taken: list[tuple[int, int]] = []
    for s, e in sorted((s, e) for _, s, e, _ in found):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    for k, s, e in more:  # what overlaps a base span or an earlier candidate is none
        i = bisect_right(taken, (s, 1 << 60))
        if not (i and taken[i - 1][1] > s) and not (i < len(taken) and taken[i][0] < e):
            taken.insert(i, (s, e))
            found.append((k, s, e, False))
    return found


def entropy(span: str) -> float:
    return -sum(n / len(span) * math.log2(n / len(span)) for n in Counter(span).values())


def iban_ok(span: str) -> bool:
    x = span.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def ip6_ok(span: str) -> bool:
    try:
        return ipaddress.ip_address(span).version == 6
    except ValueError:
        return False


def votes(text: str, kind: int, start: int, end: int, base: bool, around: int) -> tuple[int, ...]:
    """One vote of each labeler on a candidate."""
    name, span = KINDS[kind], text[start:end]
    before, after = text[max(0, start - around) : start], text[end : end + around]
    near = set(re.findall(r"[^\W_]+", (before + " " + after).lower()))
    digits = re.sub(r"[^0-9]", "", span)
    words = re.findall(r"[^\W\d_]+", span.lower())
    shape, check, gaz = int(base), 0, 0
    if name == "card":
        check = 1 if luhn(digits) and digits[:1] in "3456" else -1
    elif name == "ip":
        check = (1 if ip6_ok(span) else -1) if ":" in span else -1 if span.startswith(("0.", "255.")) else 1
        shape = 1 if base or ":" in span else 0
    elif name == "ssn":
        check = -1 if digits[:3] in ("000", "666") or digits[:1] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif name == "phone":
        check = -1 if len(set(digits)) < 3 else 1
    elif name == "iban":
        check = 1 if iban_ok(span) else -1
    elif name == "secret":
        kinds = sum(map(bool, (re.search("[a-z]", span), re.search("[A-Z]", span), digits, re.search(r"[^A-Za-z0-9]", span))))
        gaz = -1 if PLACEHOLDER.fullmatch(span) else 0
        quoted = text[start - 1 : start] in "\"'`" and text[start - 1 : start] == text[end : end + 1] != ""
        shape = 1 if KNOWN_SECRET.fullmatch(span) or kinds == 4 or quoted else -1 if kinds == 1 and len(span) < 8 else 0
        digest = re.fullmatch(r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})", span)  # as random as a secret, and more common
        check = 0 if gaz or digest else 1 if entropy(span) >= 2.75 else -1 if entropy(span) < 2 else 0
    elif name == "name":
        known = (bool(words) and words[0] in GIVEN) + (len(words) > 1 and words[-1] in FAMILY) + (len(words) == 1 and words[0] in FAMILY)
        gaz = 1 if known == len(words) or known == 2 else 0 if known else -1
        follows = re.match(r" ([^\W\d_]+)", after)
        shape = -1 if words[-1] in NO_PERSON or (follows and follows[1].lower() in NO_PERSON) else 1 if TITLED.match(text, max(0, start - 5)) or re.search(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? $", before) else 0
    elif name == "email":
        gaz = 1 if words and words[-1] in ("com", "org", "net", "edu", "de", "fr", "es") else 0
    elif name == "address":
        gaz = 1 if re.search(r"\b[0-9]{5}\b", after[:24] + before[-12:]) else 0
    own = set(re.findall(r"[^\W_]+", text[max(0, start - 24) : start].lower()))
    context = -1 if own & AGAINST else 1 if near & FOR[name] else -1 if near & AGAINST else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    neighbours = -1 if left.isalnum() or right.isalnum() else 0
    return shape, check, gaz, context, neighbours


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def fit_reliabilities(patterns: pd.DataFrame, iterations: int) -> dict[tuple, float]:
    """EM over (kind, base, votes..., n): posterior of each pattern. Labelers are independent given the truth."""
    post: dict[tuple, float] = {}
    v = patterns[list(LABELERS)].to_numpy(int)
    n, kinds = patterns["n"].to_numpy(float), patterns["kind"].to_numpy(int)
    for k in np.unique(kinds):
        at = kinds == k
        votes_k, n_k = v[at] + 1, n[at]
        p = 1 / (1 + np.exp(0.5 - (votes_k - 1).sum(1)))  # the start: a soft majority, an even one speaks against
        for _ in range(iterations):
            prior = (n_k @ p + 1) / (n_k.sum() + 2)
            log = np.full((2, len(p)), np.log([[1 - prior], [prior]]))
            for y, w in enumerate((1 - p, p)):
                for j in range(v.shape[1]):
                    # smoothed towards a labeler that is right more often than wrong, so that classes keep their meaning
                    c = np.array([4.0, 3.0, 1.0]) if y == 0 else np.array([1.0, 3.0, 4.0])
                    c += np.bincount(votes_k[:, j], n_k * w, 3)
                    log[y] += np.log(c / c.sum())[votes_k[:, j]]
            p = 1 / (1 + np.exp(np.clip(log[0] - log[1], -40, 40)))
        post |= {(int(k), *map(int, row)): float(x) for row, x in zip(v[at], p, strict=True)}
    return post


def features(kind: int, vote: tuple[int, ...]) -> np.ndarray:
    x = np.zeros(1 + len(KINDS) + 2 * len(LABELERS))
    x[0] = x[1 + kind] = 1
    for j, b in enumerate(vote):
        x[1 + len(KINDS) + 2 * j + (b > 0)] = b != 0
    return x


def fit_classifier(patterns: pd.DataFrame, post: dict[tuple, float]) -> np.ndarray:
    """Logistic regression (ridge, Newton steps) on the posteriors as soft targets, weighted by counts."""
    w = np.zeros(1 + len(KINDS) + 2 * len(LABELERS))
    if not len(patterns):
        return w
    rows = [(int(r.kind), tuple(int(getattr(r, c)) for c in LABELERS)) for r in patterns.itertuples()]
    x, y = np.stack([features(*r) for r in rows]), np.array([post[(k, *v)] for k, v in rows])
    n = np.log1p(patterns["n"].to_numpy(float))
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (n * (y - p)) - 0.1 * w)
    return w


def fit(docs: DataFrame, params: PiiParams = PiiParams()) -> np.ndarray:
    """Weights of the span classifier, learnt from all of ``docs`` (text)."""
    around = params.context_chars

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, int] = {}
        for b in batches:
            for text in b["text"]:
                if text:
                    for k, s, e, base in candidates(text):
                        key = (k, *votes(text, k, s, e, base, around))
                        seen[key] = seen.get(key, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["kind", *LABELERS, "n"])

    schema = "kind int, " + ", ".join(f"{c} int" for c in LABELERS) + ", n long"
    counted = docs.select("text").mapInPandas(count, schema).groupBy("kind", *LABELERS).agg(F.sum("n").alias("n"))
    patterns = counted.toPandas()  # at most kinds x 3^labelers rows
    return fit_classifier(patterns, fit_reliabilities(patterns, params.iterations))


def decide(text: str | None, weights: np.ndarray, params: PiiParams) -> tuple[list, list]:
    """Base spans and all accepted spans."""
    base, every = [], []
    for k, s, e, is_base in candidates(text or ""):
        if is_base:
            base.append((k, s, e))
            every.append((k, s, e))
        elif 1 / (1 + np.exp(-features(k, votes(text, k, s, e, False, params.context_chars)) @ weights)) >= params.accept:
            every.append((k, s, e))
    return base, every


def spans_column(text: Column, weights: np.ndarray, params: PiiParams = PiiParams()) -> Column:
    """struct of the digest columns and the redacted text's spans for a text column."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, every = decide(t, weights, params)
                n = [sum(k == i for k, _, _ in base) for i in range(4)]
                rows.append((*n, hashlib.sha256(digest(base).encode()).hexdigest(), digest(every)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return find(text)


def find_pii(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """doc_id, the counts of base spans, base_sha256 and all spans, one row per row of ``docs`` (doc_id, text)."""
    d = docs.select("doc_id", "text")
    return d.select("doc_id", spans_column(F.col("text"), fit(d, params), params).alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets; n_chars follows the new text."""
    weights = fit(docs, params)

    def masked(t: str | None) -> str | None:
        at, parts = 0, []
        for k, s, e in sorted(decide(t, weights, params)[1], key=lambda x: (x[1], -x[2])):
            if s >= at:
                parts += [t[at:s], f"<{KINDS[k]}>"]
                at = e
            elif e > at:  # overlaps the span before: its rest goes too
                at = e
        return t if at == 0 else "".join(parts) + t[at:]

    def mask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_portions(lambda texts: list(map(masked, texts)), pa.string())(batches)

    out = docs.withColumn("text", F.arrow_udf(mask, "string")("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
