"""Operators on small tables against brute force, with nulls, ties, copies and empty input."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelloom.llm import (
    bpe, components, licenses, mixing, multiset, quality, repeats, sharding, simhash, token_files, warc,
)
from labelloom.llm.common import ordered_parts
from labelloom.storage import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part int, size string"
BYTE_BPE = str(public_tokenizers.path("byte_bpe_50k.json"))
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))


def prose(r, n):
    return " ".join("".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 8))) for _ in range(n))


def corpus():
    """Copies, near copies, a passage in a third of the rows, nulls, repeated rows, a long text."""
    r = random.Random(5)
    passage, base = prose(r, 30), prose(r, 200)
    words = base.split()
    texts = [prose(r, r.randrange(5, 120)) for _ in range(60)]
    texts += [base] * 12
    texts += [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(5, 150, 10)]
    texts += [f"{prose(r, 20)}\n{passage}\n{prose(r, 9)}" for _ in range(40)]
    texts += ["", None, " \n", "é" * 80, "é" * 90, "ab" * 100, "ab" * 130, "-" * 300, "one", prose(r, 9000)]
    rows = [(i * 3 - 50, t, "en", [None, "a", "b", "hot", "hot", "hot"][i % 6], None, "k", 1, "s") for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, base, None, None, 1, "k", 1, "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_simhash_groups(docs):
    rows = corpus()
    prints = [simhash.simhash((r[1] or "").encode()) for r in rows]
    named = {}
    for r, p in zip(rows, prints, strict=True):
        if r[0] is not None:
            named[p] = min(named.get(p, r[0]), r[0])
    least = dict(named)
    changed = True
    while changed:
        changed = False
        for p in named:
            for q in named:
                if bin(p ^ q).count("1") <= 2 and least[q] < least[p]:
                    least[p], changed = least[q], True
    expected = Counter((r[0], p, least.get(p)) for r, p in zip(rows, prints, strict=True))
    got = simhash.near_duplicates(docs).collect()
    assert Counter((g["key"], g["fp"] % 2**64, g["component"]) for g in got) == expected
    stay = [r for r in simhash.deduplicate(docs).collect() if r["doc_id"] is not None]
    assert sorted(r["doc_id"] for r in stay) == sorted(set(least.values()))


def test_simhash_links_dense_cluster(spark):
    r = random.Random(2)
    base = r.getrandbits(64)
    values = {base}
    while len(values) < 150:
        v = base
        for _ in range(r.randrange(1, 5)):
            v ^= 1 << r.randrange(64)
        values.add(v)
    fps = sorted(values)
    df = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v, i) for i, v in enumerate(fps)], "fp long, key long")
    roots = {c["node"]: c["root"] for c in components.components(simhash.links(df)).collect()}
    least = list(range(len(fps)))
    for _ in fps:
        new = [min(least[j] for j in range(len(fps)) if bin(fps[i] ^ fps[j]).count("1") <= 2) for i in range(len(fps))]
        if new == least:
            break
        least = new
    assert [roots.get(i, i) for i in range(len(fps))] == least


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 52)]])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    expected = {n: find(n) for n in parent if any(n in e and e[0] != e[1] for e in edges)}
    got = components.components(df).collect()
    assert len(got) == len(expected) and {g["node"]: g["root"] for g in got} == expected


def brute_cut(rows, length=50):
    """Kept bytes, removed bytes and runs of each row."""
    last = 1 << 70
    least = {}
    texts = [((last if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows]
    for k, b in texts:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            least[s] = min(least.get(s, last), k)
    for k, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < k:
                gone[p : p + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        yield bytes(c for c, g in zip(b, gone, strict=True) if not g), sum(gone), runs


def test_repeats(docs):
    rows = corpus()
    expected = Counter((r[0], len((r[1] or "").encode()), n, s, k) for r, (k, n, s) in zip(rows, brute_cut(rows), strict=True))
    got = repeats.cut_repeats(docs).collect()
    assert Counter((g["doc_id"], g["_n_bytes"], g["_n_removed"], g["_n_spans"], bytes(g["_kept"])) for g in got) == expected
    assert sum(e[2] for e in expected.elements()) > 10_000
    left = repeats.remove_repeats(docs)
    assert left.columns == docs.columns and left.count() == len(rows)


def test_repeats_slices_long_texts(spark, monkeypatch):
    r = random.Random(9)
    text = prose(r, 900)
    rows = [(1, text), (2, "x" + text[100:3000] + "y" * 60), (3, text[:700] + prose(r, 50) + "y" * 200)]
    import pyarrow as pa

    monkeypatch.setattr(repeats, "_SLICE", 97)
    block = repeats.Block(pa.chunked_array([[k for k, _ in rows]]), pa.chunked_array([[t.encode() for _, t in rows]]))
    covered = set()
    for a, b, d in zip(block.first.tolist(), block.last.tolist(), block.doc.tolist(), strict=True):
        for p in range(a, b + 1):
            assert p not in covered and p + 50 <= block.ends[d] and p >= block.begins[d]
            covered.add(p)
    assert len(covered) == sum(len(t.encode()) - 49 for _, t in rows)


def test_blocks_do_not_depend_on_arrival(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(repeats, "_SLICE", 211)
    rows = [(r[0], (r[1] or "").encode(), 3) for r in corpus()[-40:]]
    hashes = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        table = pa.table({"_key": [r[0] for r in rows], "_text": [r[1] for r in rows], "_block": [r[2] for r in rows]})
        sent = repeats._anchors(5)(table)
        told = repeats._repeated(sent)
        hashes.append((told.to_pydict(), repeats._stretches(5)(table, told).to_pydict()))
    assert hashes[0] == hashes[1] and hashes[0][1]["bytes"]


def test_mixing(docs):
    sized = docs.select(F.col("doc_id").alias("id"), "source", mixing.word_count().alias("size"))
    got = mixing.assign(sized, "id", shards=4).collect()
    assert len(got) == len(corpus())
    names = sorted({g["source"] for g in got if g["source"] is not None}) + [None]
    sizes = {s: sum(g["size"] for g in got if g["source"] == s) for s in names}
    weights = {s: i % 3 + 1 for i, s in enumerate(names)}
    goal, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = {s: left * weights[s] / sum(weights[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            goal = share | {s: 3.0 * sizes[s] for s in full}
            break
        full |= over
    for s in names:
        rows = [g for g in got if g["source"] == s]
        assert all(abs(g["target"] - goal[s]) < 1e-6 and g["source_size"] == sizes[s] for g in rows)
        taken = sum(g["size"] * len(g["draws"]) for g in rows)
        assert abs(taken - goal[s]) <= max(g["size"] for g in rows)
        assert all(len(g["draws"]) <= 3 for g in rows)
    again = mixing.assign(sized.repartition(3), "id", shards=4).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))
    mixed = mixing.mix(sized, "id", shards=4)
    assert mixed.count() == sum(len(g["draws"]) for g in got)


def test_rendezvous(docs):
    n = 300
    weights = [1.0, 2.0, 1.0]
    keys = docs.sparkSession.range(6000)
    owner = {r["id"]: (r["a"], r["b"]) for r in keys.select(
        "id", sharding.rendezvous(F.col("id"), weights).alias("a"), sharding.rendezvous(F.col("id"), [*weights, 1.0]).alias("b")
    ).collect()}
    assert all(b in (a, 3) for a, b in owner.values())
    counts = Counter(a for a, _ in owner.values())
    assert abs(counts[1] - 3000) < n and abs(counts[0] - 1500) < n
    placed = sharding.slots(sharding.shard_rows(docs.select("doc_id", "text"), "doc_id", [1.0] * 3), "shard", ["doc_id", "text"], 7).collect()
    for s in range(3):
        found = sorted(p["slot"] for p in placed if p["shard"] == s)
        assert found == list(range(len(found)))
    assert len(placed) == len(corpus())
    with pytest.raises(ValueError):
        sharding.rendezvous(F.col("id"), [1.0, 0.0])


def test_token_files(docs, monkeypatch):
    spark = docs.sparkSession
    monkeypatch.setattr("labelloom.llm.common.PART_BYTES", 2000)
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    library, start, expected = Tokenizer.from_file(BYTE_BPE), 0, []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        expected.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = token_files.write_tokens(docs, new_path(spark, "t"), BYTE_BPE, length=64, batch=4)
    got = token_files.read_checksums(manifest, 64, 4).collect()
    assert Counter((g["key"], g["start"], g["n_tokens"], g["ids_crc32"]) for g in got) == Counter(expected)
    one = max(got, key=lambda g: g["first"])
    file = token_files.TokenFile(one["file"], 64, 4)
    last = (one["first"] + one["n_tokens"] - 1) // 64
    ids, mask = file.sequence(last)
    used = one["first"] + one["n_tokens"] - last * 64
    assert mask.tolist() == [i < used for i in range(64)] and ids[used - 1] == 2 and not ids.flags.owndata


def test_bpe_digests(docs):
    library = Tokenizer.from_file(WORD_BPE)
    expected = Counter()
    for r in corpus():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.token_digests(docs, WORD_BPE).collect())) == expected
    some = bpe.tokenize(docs.filter("doc_id = -50"), WORD_BPE).first()
    assert some["decoded"] == library.decode(library.encode(corpus()[0][1], add_special_tokens=False).ids, skip_special_tokens=False)


@pytest.mark.parametrize("part_bytes", [1500, 10**9])
def test_multiset_successors(docs, monkeypatch, part_bytes):
    monkeypatch.setattr("labelloom.llm.common.PART_BYTES", part_bytes)
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    expected = Counter()
    for i, r in enumerate(rows):
        text, after = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        edited = multiset.replace_half(text, after)
        a, b, c = map(multiset.fingerprint, (text, edited, after))
        expected[
            r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), multiset.as_text(a), multiset.as_text(b),
            multiset.likeness(a, b), multiset.likeness(a, c),
        ] += 1
    assert Counter(map(tuple, multiset.with_successor(docs).collect())) == expected


def test_ordered_parts(docs, empty, monkeypatch):
    monkeypatch.setattr("labelloom.llm.common.PART_BYTES", 1500)
    placed, n = ordered_parts(docs.drop("part"))
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["part"]) for r in placed.collect())
    assert n > 5 and [p for _, p in rows] == sorted(p for _, p in rows)
    assert ordered_parts(empty.drop("part"))[1] == 1


def page_rows():
    r = random.Random(4)
    big = prose(r, 400)
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [big, big, prose(r, 300), "", None, "small", "small", big, f"x{inner}y{'z' * 1200}", inner, "WARC/1.0\r\n", "é\r\n\r\nWARC/1.0\r\nContent-Length: 99999\r\n\r\n" + big]
    return [(i, f"http://h/{i}\r\nX: y" if i % 2 else None, p, "extra") for i, p in enumerate(pages)] + [(None, "u", "no id", "extra")]


@pytest.mark.parametrize("zone", [64_000_000, 700])
def test_warc_round_trip(spark, zone):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(2)
    folder = new_path(spark, "warc")
    warc.write_archive(pages, folder)
    got = warc.read_archive(spark, folder, zone).collect()
    largest = {}
    for i, _, p, _ in rows:
        if p and len(p.encode()) >= 1000 and i is not None:
            largest[p] = max(largest.get(p, i), i)
    assert len(got) == len(rows)
    by_id = {g["record_id"]: g for g in got}
    for i, _, p, _ in rows:
        g = by_id[f"<urn:page:{'none' if i is None else i}>"]
        data = (p or "").encode()
        digest = hashlib.sha1(data).hexdigest()
        if largest.get(p, i) != i:
            assert (g["record_type"], g["refers_to"], g["length"]) == ("revisit", f"<urn:page:{largest[p]}>", 0)
            assert (g["said_digest"], g["said_bytes"]) == (f"sha1:{digest}", len(data))
        else:
            assert (g["record_type"], g["digest"], g["length"], g["refers_to"]) == ("response", digest, len(data), None)


def test_warc_rejects_what_no_chain_reaches(spark):
    import pyarrow as pa

    jump = pa.table({"file": ["f"] * 4, "end": [64_000_000] * 4, "offset": [0, 10, 25, 40], "next": [25, 99, 40, 64_000_000], "entry": [0] * 4})
    assert warc._reached(jump).column("offset").to_pylist() == [0, 25, 40]
    assert warc._exits(jump).column("exit").to_pylist() == [64_000_000, -1, 64_000_000, 64_000_000]


def test_licenses(spark):
    r = random.Random(3)
    mit, apache = licenses.TEMPLATES[0][1], licenses.TEMPLATES[2][1]
    long = licenses.TEMPLATES[1][1]
    rows = [
        (1, None), (2, ""), (3, f"{prose(r, 400)}\n{mit.upper()} {prose(r, 5)}"), (4, f"{apache}\n{prose(r, 300)} {long}"),
        (5, "Released under the"), (6, long.replace("obtaining", "getting")), (7, " ".join(long.split()[:12])), (3, mit), (None, apache),
        (8, " ".join([prose(r, 126), *[t for _, t in licenses.TEMPLATES]])),
    ]
    df = spark.createDataFrame([(*x, "e") for x in rows], "doc_id long, text string, license string")
    got = Counter((g["key"], g["notice"]) for g in licenses.scan(df).collect())
    assert got == Counter([(3, 0), (3, 0), (4, 2), (4, 1), (None, 2), *[(8, i) for i in range(len(licenses.TEMPLATES))]])
    with pytest.raises(ValueError):
        licenses.scan(df, templates=[("X", "too short")])


def test_quality_removes_host_lines(spark):
    r = random.Random(6)
    menu = "Home About Contact"
    rows = [(i, f"{menu}\n{prose(r, 60)}", "h") for i in range(25)]
    rows += [(100 + i, f"{menu}\n{prose(r, 60)}", "g") for i in range(5)]
    rows += [(200 + i, "\n".join([f" HOME about\tcontact {k}" for k in range(30)] + [f"own {i}"]), "h") for i in range(25)]
    rows += [(300 + i, prose(random.Random(1), 70), "h") for i in range(40)]
    rows += [(400, None, None), (401, "", "h")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, source string, n_words int")
    got = {g["doc_id"]: g for g in quality.apply_rules(df).collect()}
    assert menu not in got[0]["text"] and menu in got[100]["text"]
    assert not any(200 <= i < 300 for i in got)
    assert sum(300 <= i < 400 for i in got) == 40
    assert 400 not in got and 401 not in got
    assert quality.apply_rules(df).columns == df.columns


def test_empty_tables(spark, empty):
    assert simhash.near_duplicates(empty).count() == simhash.deduplicate(empty).count() == 0
    assert repeats.cut_repeats(empty).count() == repeats.remove_repeats(empty).count() == 0
    assert quality.apply_rules(empty).count() == quality.verdicts(empty).count() == 0
    sized = empty.select("doc_id", "source", F.lit(0).cast("long").alias("size"))
    assert mixing.assign(sized, "doc_id", 4).count() == mixing.mix(sized, "doc_id", 4).count() == 0
    assert sharding.slots(sharding.shard_rows(empty, "doc_id", [1.0]), "shard", ["doc_id"]).count() == 0
    assert token_files.read_checksums(token_files.write_tokens(empty, new_path(spark, "t"), BYTE_BPE)).count() == 0
    assert bpe.token_digests(empty, WORD_BPE).count() == multiset.with_successor(empty).count() == 0
    assert licenses.scan(empty).count() == 0
    folder = new_path(spark, "warc")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_archive(spark, folder).count() == 0


def test_pipeline(docs, spark):
    import corpus_pipeline

    current = docs
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "stage")
        stage(spark, current, "").write.parquet(path)
        current = spark.read.parquet(path)
        counts.append(current.count())
        if stage is not corpus_pipeline.tokens:
            assert current.columns == docs.columns
    assert counts[0] >= counts[1] == counts[2] and counts[3] == counts[4] > 0
