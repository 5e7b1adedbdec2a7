"""Licence scan: a paragraph classifier with an unknown class, confirmed by template comparison.

Sparse word n-gram counts (one to three words) feed a multinomial logistic regression over licence families and an
unknown class. It is trained on varied forms of the templates below, on sentences that only sound like licences, and
on a bounded sample of corpus paragraphs as unknowns; a temperature fitted on left-out forms calibrates the
probabilities. A predicted family must be confirmed: enough of the word pairs of one of its templates must be in the
paragraph, else it counts as unknown. Paragraphs are lines; where a line is none by itself, it is joined with the
lines after it, up to the next blank one, as long as each goes on with the same template. Such a paragraph is
reported at its first line.

A paragraph with too few word pairs of every template cannot be confirmed and is not scored; no figure of the corpus
decides on that. Texts are read once where they are; nothing is shuffled.

Edge cases: null and empty texts have no licence; very long lines are scored whole; repeated rows are each reported;
further columns are ignored; an empty table gives an empty result (the unknown class then has the fixed sentences).
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import lowest_hashes

#: Usual notices of each family: fixed values.
TEMPLATES = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "This file is licensed to you under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license", "The MIT License (MIT)", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "either version 3 of the License, or (at your option) any later version of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "This work is in the public domain."],
    "proprietary": ["All rights reserved.", "Copyright held by the publisher. All rights reserved. No part of this publication may be reproduced"],
}
#: Sentences that only sound like licences: fixed values.
ALIKE = [
    "He lost his driving license last year.", "The license plate was found near the road.", "MIT researchers published a new study in version 2 of the report.",
    "The Apache helicopter landed at noon.", "Version 3.0 of the plan was approved by the general assembly.", "A public library serves the general public.",
    "All rights and duties follow from the contract.", "The creative industries have much in common.", "She granted permission to enter the house free of charge.",
    "The restaurant has a liquor license.", "This work is the result of many years.", "The gnu is a large antelope of the public reserve.",
    "Released under pressure from the public, the report had 4.0 pages.", "The software was sold under the counter.", "The terms of the agreement are international.",
]
UNKNOWN = "unknown"


@dataclass(frozen=True)
class LicenseParams:
    forms: int = 24  # varied forms of each template
    sample: int = 3_000  # corpus paragraphs at most, as unknowns
    sample_chars: int = 5_000  # of each of them, at most: a window at a place that its hash gives
    accept: float = 0.5  # least calibrated probability
    overlap: float = 0.6  # of a template's word pairs
    seed: int = 5


def words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())


def grams(tokens: list[str]) -> list[str]:
    return [" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)]


def pairs(tokens: list[str]) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + 2]) for i in range(max(1, len(tokens) - 1))} if tokens else set()


def forms(template: str, r: random.Random, n: int) -> Iterator[str]:
    """Varied forms: words around, a word left out or doubled, other case."""
    around = ["see the file", "copyright 2019 the authors", "for details", "all files here are", "notice", "www.example.org", "please note", "c 2021", "code and data", "unless stated otherwise"]
    for _ in range(n):
        t = template.split()
        if len(t) > 5 and r.random() < 0.4:
            del t[r.randrange(len(t))]
        if r.random() < 0.2:
            i = r.randrange(len(t))
            t.insert(i, t[i])
        text = " ".join([r.choice(around)] * (r.random() < 0.4) + t + [r.choice(around)] * (r.random() < 0.4))
        yield text.upper() if r.random() < 0.1 else text


@dataclass
class Model:
    families: list[str]
    index: dict[str, int]
    weights: np.ndarray  # [grams + 1, families]; the last row is the bias
    temperature: float
    params: LicenseParams
    templates: dict[str, list[set[tuple[str, ...]]]] = field(default_factory=lambda: {f: [pairs(words(t)) for t in ts] for f, ts in TEMPLATES.items()})

    def __post_init__(self) -> None:
        self.flat = [t for ts in self.templates.values() for t in ts]
        self.holders: dict[tuple[str, ...], list[int]] = {}  # templates with a word pair
        for i, t in enumerate(self.flat):
            for x in t:
                self.holders.setdefault(x, []).append(i)

    def shared(self, tokens: list[str]) -> dict[int, set[tuple[str, ...]]]:
        """The word pairs of each template that are in ``tokens``."""
        out: dict[int, set[tuple[str, ...]]] = {}
        for x in zip(tokens, tokens[1:], strict=False):
            for i in self.holders.get(x, ()):
                out.setdefault(i, set()).add(x)
        return out

    def enough(self, shared: dict[int, set[tuple[str, ...]]]) -> bool:
        return any(len(x) >= self.params.overlap * len(self.flat[i]) for i, x in shared.items())

    def vector(self, tokens: list[str]) -> tuple[list[int], np.ndarray]:
        c = Counter(i for g in grams(tokens) if (i := self.index.get(g)) is not None)
        return list(c), np.sqrt(np.fromiter(c.values(), float, len(c)))

    def probabilities(self, tokens: list[str]) -> np.ndarray:
        at, x = self.vector(tokens)
        z = (x @ self.weights[at] + self.weights[-1]) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def judge(self, line: str) -> tuple[str, float, float] | None:
        """(family, probability, overlap with its best template) of a licence paragraph."""
        tokens = words(line)
        return self.classify(tokens) if self.enough(self.shared(tokens)) else None

    def classify(self, tokens: list[str]) -> tuple[str, float, float] | None:
        p = self.probabilities(tokens)
        k = int(p.argmax())
        family = self.families[k]
        if family == UNKNOWN or p[k] < self.params.accept:
            return None
        own = pairs(tokens)
        overlap = max(len(t & own) / len(t) for t in self.templates[family])
        return (family, float(p[k]), overlap) if overlap >= self.params.overlap else None

    def scan(self, text: str | None) -> list[tuple[int, str, float, float]]:
        """(paragraph, family, probability, overlap) of a text's licence paragraphs."""
        lines = [words(line) for line in (text or "").split("\n")]
        has = [self.shared(x) for x in lines]
        out = [(i, *found) for i, x in enumerate(lines) if has[i] and self.enough(has[i]) and (found := self.classify(x))]
        alone, at = {i for i, *_ in out}, 0
        while at < len(lines) - 1:
            end, found = self.wrapped(lines, has, at, alone)
            if found:
                out.append((at, *found))
            at = end + 1 if found else at + 1
        return sorted(out)

    def wrapped(self, lines: list[list[str]], has: list[dict], at: int, alone: set[int]) -> tuple[int, tuple[str, float, float] | None]:
        """The paragraph that begins in line ``at`` and goes on in the next ones: its last line, what it is."""
        tokens, shared, end = lines[at], has[at], at + 1
        while tokens and at not in alone and end < len(lines) and lines[end] and end not in alone:
            border = self.shared([lines[end - 1][-1], lines[end][0]])
            if end == at + 1:
                shared = {i: shared.get(i, set()) for i in shared.keys() | border.keys()}
            shared = {i: x | more for i, x in shared.items() if (more := has[end].get(i, set()) | border.get(i, set()))}
            if not shared:
                break
            tokens = tokens + lines[end]
            if self.enough(shared) and (found := self.classify(tokens)):
                return end, found
            end += 1
        return at, None


def softmax_fit(rows: list[tuple[list[int], np.ndarray]], y: np.ndarray, m: int, k: int, ridge: float = 0.02, steps: int = 150) -> np.ndarray:
    """Ridge multinomial logistic regression by accelerated gradient steps."""
    at = np.concatenate([np.array(a, dtype=np.int64) for a, _ in rows])
    value = np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    onehot, w, before = np.eye(k)[y], np.zeros((m + 1, k)), np.zeros((m + 1, k))
    step = 1 / (0.5 * (np.bincount(row, value**2).max() + 1) * len(rows) / 8 + ridge)
    order = np.argsort(at, kind="stable")
    cols, first = np.unique(at[order], return_index=True)
    for i in range(steps):
        look = w + (i / (i + 3)) * (w - before)
        z = np.add.reduceat(value[:, None] * look[at], np.flatnonzero(np.diff(row, prepend=-1)), 0) + look[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = np.zeros_like(w)
        g[cols] = np.add.reduceat((value[:, None] * (p - onehot)[row])[order], first, 0)
        g[-1] = (p - onehot).sum(0)
        before, w = w, look - step * (g + ridge * look)
    return w


def fit(unknown: list[str], params: LicenseParams = LicenseParams()) -> Model:
    """``unknown``: paragraphs of the corpus; those that hold a whole template are left out."""
    r = random.Random(params.seed)
    families = [*TEMPLATES, UNKNOWN]
    # (words, family, whether its template is left out of the weights that are calibrated: one of each family with four or more)
    data = [(words(x), k, len(TEMPLATES[f]) > 3 and j == params.seed % len(TEMPLATES[f])) for k, f in enumerate(families[:-1]) for j, t in enumerate(TEMPLATES[f]) for x in (t, *forms(t, r, params.forms))]
    whole = [pairs(words(t)) for ts in TEMPLATES.values() for t in ts]
    plain = [w for x in unknown if (w := words(x)) and (own := pairs(w)) and not any(len(t & own) >= params.overlap * len(t) for t in whole)]
    data += [(words(x), len(families) - 1, False) for t in ALIKE for x in (t, *forms(t, r, params.forms))]
    index = {g: i for i, g in enumerate(sorted({g for w, *_ in data for g in grams(w)}))}
    data += [(w, len(families) - 1, False) for w in plain]
    model = Model(families, index, np.zeros((len(index) + 1, len(families))), 1.0, params)
    # calibration on what the weights haven't seen: other forms, and forms of whole templates left out
    r.shuffle(data)
    rows = [model.vector(w) for w, *_ in data]
    full = [i for i, (a, _) in enumerate(rows) if a]
    rows, y, out = [rows[i] for i in full], np.array([data[i][1] for i in full]), np.array([data[i][2] for i in full])
    later = out | (np.arange(len(rows)) >= 4 * len(rows) // 5)
    train = np.flatnonzero(~later)
    weights = softmax_fit([rows[i] for i in train], y[train], len(index), len(families))
    z, left = np.stack([v @ weights[a] + weights[-1] for a, v in (rows[i] for i in np.flatnonzero(later))]), y[later]

    def loss(t: float) -> float:
        s = z / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), left]).mean())

    model.temperature = min(np.geomspace(0.1, 5, 60), key=loss)
    model.weights = softmax_fit(rows, y, len(index), len(families))
    return model


def sample_paragraphs(docs: DataFrame, params: LicenseParams) -> list[str]:
    """A bounded sample of distinct paragraphs of all texts, by hash: what trains the unknown class."""
    lines = docs.where("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    spare = F.greatest(F.length("line") - params.sample_chars, F.lit(0))
    at = (F.pmod(F.xxhash64("line", F.lit(1)), spare + 1) + 1).cast("int")  # of a long one a window somewhere, by its hash
    some = lowest_hashes(lines, F.col("line"), params.sample, F.substring("line", at, F.lit(params.sample_chars)).alias("line"))
    return [row.line for row in some.collect()]


def scan_licenses(spark: SparkSession, docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, paragraph, family, probability, overlap of every licence paragraph of ``docs`` (doc_id, text)."""
    shared = spark.sparkContext.broadcast(fit(sample_paragraphs(docs, params), params))
    columns = ["doc_id", "paragraph", "family", "probability", "overlap"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for b in batches:
            rows = [(None if pd.isna(i) else int(i), *x) for i, t in zip(b["doc_id"], b["text"], strict=True) for x in model.scan(t)]
            yield pd.DataFrame(rows, columns=columns).astype({"doc_id": "Int64", "paragraph": "int32", "family": object, "probability": float, "overlap": float})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, paragraph int, family string, probability double, overlap double")
