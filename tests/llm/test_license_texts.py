"""Whole license texts with edits, wording variants and notices of under five words."""

import random

from labelloom.llm import license_texts, licenses


def _edited(text, r, share):
    """Single words changed, far apart: each takes five shingles along."""
    w = text.split()
    for k in range(10, len(w) - 10, round(5 / share)):
        w[k] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def test_edited_texts_and_variants(spark):
    r = random.Random(8)
    filler = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    base = len(licenses.TEMPLATES) - len(license_texts.TEXTS)
    long = [(base + i, n, t) for i, (n, t) in enumerate(license_texts.TEXTS) if len(t.split()) >= 60]
    assert {"MIT", "ISC", "Zlib", "Unlicense", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "LGPL-3.0", "AGPL-3.0"} <= {n for _, n, _ in long}
    rows = [(i, f"{filler(150)} {_edited(t, r, 0.13)} {filler(20)}") for i, _, t in long]
    rows += [(1000 + i, f"{filler(40)} {_edited(t, r, 0.35)} {filler(20)}") for i, _, t in long]
    rows.append((5000, f"{filler(9)} Licensed under the MIT License {filler(9)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(g["key"], g["notice"]): g["containment"] for g in licenses.scan(df).collect()}
    for i, _, _ in long:
        assert 0.8 <= got[i, i] < 1 and (1000 + i, i) not in got
    assert {licenses.TEMPLATES[n][0] for k, n in got if k == 5000} == {"MIT"}


def test_short_notices(spark):
    df = spark.createDataFrame([(1, "a b (c) 2020 ALL rights reserved."), (2, "all rights"), (3, None)], "doc_id long, text string")
    got = licenses.scan(df, templates=license_texts.SHORT, shingle=licenses.SHORT_SHINGLE).collect()
    assert [(g["key"], g["license"], g["word"]) for g in got] == [(1, "proprietary", 4)]
