"""Collocations, ranked search and language model against brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from labelloom.llm import collocations, language_model, ranking

WORDS = "the of and to in a is that for it as was with be by on not he".split()
SCHEMA = "doc_id long, text string, lang string, n int, score string, rank string, phrase string"


def sentence(r, n):
    return " ".join(r.choice(WORDS[: r.randrange(3, len(WORDS))]) for _ in range(n))


def rows():
    r = random.Random(8)
    texts = [f"{sentence(r, r.randrange(1, 60))}, {sentence(r, 9)}.\n{sentence(r, 5)}" for _ in range(120)]
    texts += ["New  York City\tHall; new york city hall. NEW YORK"] * 9 + ["É\x0bé É É", "", None, " \n.,", "-", "x" * 300, sentence(r, 4000)]
    out = [(i * 7, t, [None, "en", "en", "de"][i % 4], 1, "s", "r", "p") for i, t in enumerate(texts)]
    return [*out, out[5], out[-1], (None, texts[3], "en", 1, "s", "r", "p"), (None, None, None, 1, "s", "r", "p")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_counts(longest=4):
    counts, totals = Counter(), Counter()
    for _, text, lang, *_ in rows():
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang or "und", tuple(words[i : i + n])] += 1
    return counts, totals


def brute_collocations(least, top):
    counts, totals = brute_counts()
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    covered = defaultdict(int)
    for (lang, p), a in found.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                covered[lang, p[i : i + n]] = max(covered[lang, p[i : i + n]], a)
    best = defaultdict(list)
    for (lang, p), a in found.items():
        if 100 * covered[lang, p] >= 80 * a:
            continue
        cuts = []
        for k in range(1, len(p)):
            left, right = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        best[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {
        (lang, i, p.decode(), -a, left, right, totals[lang], -s)
        for lang, found in best.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    }


# A sample of every document; one that proposes little, so that borders fail; a table with chance hits.
@pytest.mark.parametrize(("sample", "bits"), [(1, 1 << 20), (40, 1 << 20), (7, 1 << 8)])
def test_collocations(docs, monkeypatch, sample, bits):
    monkeypatch.setattr(collocations, "_CHUNK", 700)
    got = collocations.collocations(docs, min_count=6, top=30, sample=sample, filter_bits=bits).collect()
    expected = brute_collocations(6, 30)
    assert len(got) == len(expected) and set(map(tuple, got)) == expected


def test_frequent_phrases_are_whole(docs):
    found, totals = collocations.frequent_phrases(docs, min_count=5, sample=50)
    counts, words = brute_counts()
    assert {(g["lang"], tuple(g["phrase"].split(" "))): g["n"] for g in found.collect()} == {k: n for k, n in counts.items() if n >= 5}
    assert {g["lang"]: g["n"] for g in totals.collect()} == dict(words)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(queries, k):
    found = [(key, Counter(TERM.findall(lower(text)))) for key, text, *_ in rows()]
    found = [(key, c) for key, c in found if c]
    total, length = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in queries:
        scores = []
        for key, c in found:
            m = 25 + 75 * sum(c.values()) * total // length
            score = 0
            for t in TERM.findall(lower(text)):
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                score += w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, i, key, -s) for i, (s, _, _, key) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize(("block_terms", "first", "bucket"), [(200_000, 16_384, 2048), (8, 3, 5), (20, 20, 16)])
def test_search(docs, spark, monkeypatch, block_terms, first, bucket):
    monkeypatch.setattr(ranking, "BUCKET_ROWS", bucket)
    r = random.Random(3)
    queries = [(i, sentence(r, r.randrange(1, 30))) for i in range(25)]
    queries += [(30, "New York, city-hall! É é"), (31, None), (32, ""), (33, "nowhere"), (30, "york york the"), (None, "hall")]
    items = spark.createDataFrame([(*q, "e", 1) for q in queries], "item_id long, text string, key string, row int")
    got = ranking.search(docs, items, k=4, block_terms=block_terms, first_rows=first).collect()
    assert Counter(map(tuple, got)) == Counter(brute_search(queries, 4))


def test_search_lengths_beyond_64_bits():
    assert ranking.weight(10**12, 10**12) == 0 and ranking.weight(0, 0) == math.floor(1000 * math.log(2))


def brute_model(order, train):
    """Counts by size, with a mark before every text and one behind it."""
    counts = [Counter() for _ in range(order)]
    for words in train:
        seq = ["<", *words, ">"]
        for n in range(1, order + 1):
            for i in range(len(seq) - n + 1):
                counts[n - 1][tuple(seq[i : i + n])] += 1
    return counts


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model(docs, monkeypatch, order):
    monkeypatch.setattr(language_model, "BLOCK_WORDS", 900)
    monkeypatch.setattr(language_model, "PART_GRAMS", 2000)
    texts = [(r[0], [w for w in re.split("[ \t\n\x0b\x0c\r]+", lower(r[1])) if w]) for r in rows()]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in texts]
    counts = brute_model(order, [w for (_, w), h in zip(texts, held, strict=True) if not h])
    n_texts = len(texts) - sum(held)
    single = {g[0]: c for g, c in counts[0].items() if g != ("<",)}
    tokens, types = sum(single.values()), len(single)

    def discount(values):
        values = list(values)
        return (values.count(1) + 1) / (values.count(1) + 2 * values.count(2) + 2)

    d = discount(single.values())
    priors = []
    for n in range(2, order + 1):
        freed = discount(counts[n - 1].values()) * len(counts[n - 1])
        contexts = [c for g, c in counts[n - 2].items() if n > 2 or g != (">",)]
        gaps = [abs(sum(c * mu / (c + mu) for c in contexts) - freed) for mu in language_model.PRIORS]
        priors.append(gaps)

    def p(context, w, mus):
        if not context:
            return (single[w] - d) / tokens if w in single else d * types / tokens
        shorter = p(context[1:], w, mus)
        c, mu = counts[len(context) - 1][context], mus[len(context) - 1]
        return (counts[len(context)][*context, w] + mu * shorter) / (c + mu) if c else shorter

    got = language_model.score(docs, order=order).collect()
    assert len(got) == len(texts)
    # Whole numbers of freed mass are summed per part: the nearest prior or one beside it.
    best = [language_model.PRIORS[g.index(min(g))] for g in priors]
    expected = Counter()
    for (key, words), h in zip(texts, held, strict=True):
        seq, score, base = ["<", *words, ">"], 0.0, 0.0
        for i in range(1, len(seq)):
            context = tuple(seq[max(0, i - order + 1) : i])
            score += math.log10(p(context, seq[i], best))
            base += math.log10((single.get(seq[i], 0) + 1) / (tokens + types + 1))
        known = sum(w in single for w in seq[1:])
        expected[key, h, len(seq) - 1, known, tokens, round(base, 6), round(score, 6)] += 1
    assert n_texts and Counter((*g[:5], round(g[5], 6), round(g[6], 6)) for g in map(tuple, got)) == expected
    # What follows any context adds up to one, the unknown word included.
    vocabulary = [*single, "never seen"]
    for context in [(), ("the",), ("<",), ("never seen",), ("of", "the"), ("<", "the")]:
        if len(context) < order:
            assert abs(sum(p(context, w, best) for w in vocabulary) - 1) < 1e-9


def test_language_model_learns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = language_model.score(docs).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.95 * got[1]


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    items = spark.createDataFrame([], "item_id long, text string")
    assert collocations.collocations(none).count() == language_model.score(none).count() == 0
    assert ranking.search(none, items).count() == ranking.search(docs, items).count() == 0
    assert ranking.search(none, spark.createDataFrame([(1, "the")], "item_id long, text string")).count() == 0
    blank = docs.filter("text is null")
    assert collocations.collocations(blank, min_count=1).count() == 0
    held = language_model.score(docs, chosen=F.lit(True)).agg(F.sum("score"), F.sum("base_score"), F.sum("n_known")).first()
    assert tuple(held) == (0.0, 0.0, 0)
