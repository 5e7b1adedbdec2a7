import random

import pytest

from quernstone.llm.licenses import ALIKE, TEMPLATES, LicenseParams, fit, forms, sample_paragraphs, scan_licenses

from .data import documents, no_documents, prose


@pytest.fixture(scope="module")
def model():
    return fit([prose(i, 15) for i in range(300)])


def test_unseen_forms_and_sound_alikes(model):
    r, right, n = random.Random(31), 0, 0
    for family, templates in TEMPLATES.items():
        for t in templates:
            for x in forms(t, r, 12):
                found, n = model.judge(x), n + 1
                right += found is not None and found[0] == family
    assert right >= 0.93 * n
    assert not any(model.judge(x) for x in ALIKE)
    assert not any(model.judge(prose(i, 30)) for i in range(100))


def test_probabilities_are_calibrated_and_sum_to_one(model):
    p = model.probabilities("licensed under the apache license version 2.0".split())
    assert abs(p.sum() - 1) < 1e-9 and p.max() > 0.8


def test_rows_and_edges(spark):
    rows = [(50, "Some text.\nReleased under the MIT License.\nmore"), (51, "All rights reserved."), (51, "All rights reserved."), (52, "The license plate was red.")]
    docs = documents(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    got = sorted((r.doc_id, r.paragraph, r.family) for r in scan_licenses(spark, docs).collect())
    assert got == [(50, 1, "mit"), (51, 0, "proprietary"), (51, 0, "proprietary")]
    assert scan_licenses(spark, no_documents(spark)).count() == 0


def test_frequent_words_of_the_corpus_do_not_hide_a_licence():
    model = fit([f"Some rights reserved. All of it, {prose(i, 12)}" if i % 3 == 0 else prose(i, 15) for i in range(300)])
    assert model.judge("All rights reserved.")[0] == "proprietary"
    assert not any(model.judge(prose(i, 30)) for i in range(100))


@pytest.mark.parametrize("width", [1, 3, 5])
def test_wrapped_notices(model, width):
    for family, template in (("mit", TEMPLATES["mit"][2]), ("bsd", TEMPLATES["bsd"][0]), ("gpl-3.0", TEMPLATES["gpl-3.0"][1]), ("cc0-1.0", TEMPLATES["cc0-1.0"][1])):
        w = template.split()
        lines = [" ".join(w[i : i + width]) for i in range(0, len(w), width)]
        found = model.scan("\n".join([prose(1, 8), "", *lines, "", prose(2, 8)]))
        assert [f for _, f, *_ in found] == [family] and 2 <= found[0][0] < 2 + len(lines)
    assert not model.scan("\n".join(" ".join(x) for x in zip(*[iter(prose(3, 900).split())] * 3)))


GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY."""


def test_usual_headers_and_titles(model):
    own = lambda text: [f for _, f, *_ in model.scan(text)]
    assert own(GPL) == ["gpl-3.0"] and own("\n".join(f" * {x.strip()}" for x in GPL.split("\n"))) == ["gpl-3.0"]
    assert own("GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007") == ["gpl-3.0"]
    assert own("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice appear in all copies.") == ["isc"]
    assert own("Apache License\nVersion 2.0, January 2004") == ["apache-2.0"] and own("Mozilla Public License Version 2.0") == ["mpl-2.0"]
    assert own("The general public was given a license to fish, version 3 of it.") == []


def test_the_sample_is_of_all_paragraphs(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"line {i} {j}" for j in range(50))) for i in range(40)] + [(99, None), (98, "")], "doc_id long, text string")
    some = sample_paragraphs(docs, LicenseParams(sample=300))
    assert len(set(some)) == 300 and len({x.split()[2] for x in some}) == 50  # not only the first lines
