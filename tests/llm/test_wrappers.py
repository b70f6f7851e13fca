"""Registered queries without SQL, run as registered on a small table, against independent code."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def rows(small):
    table = pq.read_table(f"{small}/documents.parquet").to_pylist()
    return {r["doc_id"]: r for r in table}


def run(spark, small, name):
    return {r["doc_id"]: r for r in entry.queries()[name](spark, small).collect()}


def fingerprint(text):
    """Bit by bit, as the contract of the query says."""
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_op1(spark, small, rows):
    got = run(spark, small, "op1_simhash_groups")
    prints = {k: fingerprint(r["text"]) for k, r in rows.items()}
    assert {k: g["fingerprint"] for k, g in got.items()} == {k: f"{p:016x}" for k, p in prints.items()}
    root = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    assert {k: g["component_id"] for k, g in got.items()} == root


def test_op3(spark, small, rows):
    got = run(spark, small, "op3_suffix_dedup")
    first = {}
    texts = {k: (r["text"] or "").encode() for k, r in sorted(rows.items())}
    for k, b in texts.items():
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], k)
    for k, b in texts.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < k:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        g = got[k]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"]) == (len(b), sum(gone), spans)
        assert g["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_op5(spark, small, rows):
    got = run(spark, small, "op5_mix_sources")
    assert set(got) == set(rows)
    taken, target = Counter(), {}
    for k, g in got.items():
        assert g["size"] == len([w for w in (rows[k]["text"] or "").replace("\x0b", " ").split() if w]) or "\x85" in rows[k]["text"]
        assert g["taken"] <= 3 * g["size"]
        taken[rows[k]["source"]] += g["taken"]
        target[rows[k]["source"]] = g["target"]
    largest = max(g["size"] for g in got.values())
    assert all(abs(taken[s] - target[s]) <= largest for s in target)


def rendezvous(key, shards):
    """Highest score of -1 / ln(u), with u from the published hash of seed, key and shard."""
    best = None
    for i in range(shards):
        h = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)
        h = xxhash.xxh64_intdigest(str(key).encode(), h)
        h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), h)
        score = -1 / math.log(((h >> 12) + 0.5) / 2**52)
        if best is None or score > best[0]:
            best = (score, i)
    return best[1]


def test_op6(spark, small, rows):
    got = run(spark, small, "op6_rendezvous_shards")
    slots = defaultdict(list)
    for k, r in rows.items():
        g, data = got[k], (r["text"] or "").encode()
        assert (g["shard"], g["grown_shard"]) == (rendezvous(k, 8), rendezvous(k, 9))
        assert (g["size"], g["text_crc32"], g["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        slots[g["shard"]].append(g["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def vector(text):
    """Sum of the signs that a 256-bit hash gives each piece, piece by piece."""
    total = [0] * 256
    for line in text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n"):
        if line.strip():
            digest = hashlib.blake2b(line.strip().encode(), digest_size=32).digest()
            for i in range(256):
                total[i] += 1 if digest[i // 8] >> (7 - i % 8) & 1 else -1
    return total


def likeness(a, b):
    square = lambda v: sum(x * x for x in v)
    size, apart = square(a) + square(b), square([x - y for x, y in zip(a, b, strict=True)])
    return 1.0 if apart == 0 else max(0.0, 1 - apart / size)


def pieces(text):
    found = text.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")
    return Counter(p.strip() for p in found if p.strip())


def test_op10(spark, small, rows):
    got = run(spark, small, "op10_multiset_fingerprints")
    keys = sorted(rows)
    off = []
    for k, after in zip(keys, keys[1:] + keys[:1], strict=True):
        text, following, g = rows[k]["text"] or "", rows[after]["text"] or "", got[k]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = vector(text), vector(edited), vector(following)
        as_hex = lambda v: np.array(v).astype("<i2").tobytes().hex()
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (g["fingerprint"], g["edited_fingerprint"]) == (as_hex(a), as_hex(b))
        assert g["near_edited"] == pytest.approx(likeness(a, b)) and g["near_next"] == pytest.approx(likeness(a, c))
        # The likeness stands for 1 - |difference|^2 / (|a|^2 + |b|^2) of the multisets of pieces.
        x, y = pieces(text), pieces(edited)
        both = set(x) | set(y)
        size = sum(x[p] ** 2 + y[p] ** 2 for p in both)
        true = 1 - sum((x[p] - y[p]) ** 2 for p in both) / size if size else 1.0
        off.append(abs(g["near_edited"] - true))
    assert sum(off) / len(off) < 0.1


@pytest.mark.parametrize("name", ["op7_arrow_token_files", "op9_bpe_round_trip", "op13_language_model"])
def test_one_row_per_document(spark, small, rows, name):
    got = run(spark, small, name)
    assert set(got) == set(rows) and not any(v is None for g in got.values() for v in g.asDict().values())


def test_op4(spark, small):
    pages = pq.read_table(f"{small}/pages.parquet").to_pylist()
    got = {r["page_id"]: r for r in entry.queries()["op4_warc_round_trip"](spark, small).collect()}
    largest = {}
    for p in pages:
        data = (p["html"] or "").encode()
        if len(data) >= 1000:
            largest[data] = max(largest.get(data, p["page_id"]), p["page_id"])
    for p in pages:
        data, g = (p["html"] or "").encode(), got[p["page_id"]]
        kept = largest.get(data, p["page_id"])
        assert (g["payload_bytes"], g["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (g["record_type"], g["refers_to"]) == (("response", None) if kept == p["page_id"] else ("revisit", kept))
    assert len(got) == len(pages)


def test_pipeline_runs_whole(spark, small, rows):
    """What every stage keeps, by independent code where the rule is short."""
    import corpus_pipeline
    from labelloom.llm import quality
    from labelloom.storage import written

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), name.replace(" ", "-"))
        kept.append({i: r.asDict() for i, r in enumerate(docs.collect())})
    verdict = {r["key"]: r for r in quality.verdicts(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    assert {r["doc_id"] for r in kept[0].values()} == {k for k, v in verdict.items() if v["kept"]}
    assert all(r["n_chars"] == len(r["text"]) for r in kept[0].values())
    left = {r["doc_id"]: r["text"] for r in kept[0].values()}
    prints = {k: fingerprint(x) for k, x in left.items()}
    root = {k: k for k in prints}
    for _ in prints:
        new = {a: min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 2) for a in prints}
        if new == root:
            break
        root = new
    assert {r["doc_id"] for r in kept[1].values()} == set(root.values())
    first = {}
    texts = {r["doc_id"]: r["text"].encode() for r in kept[1].values()}
    for k in sorted(texts):
        for p in range(len(texts[k]) - 49):
            first.setdefault(texts[k][p : p + 50], k)
    assert {r["doc_id"] for r in kept[2].values()} == set(texts)
    for r in kept[2].values():
        b = texts[r["doc_id"]]
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < r["doc_id"]:
                gone[p : p + 50] = b"\1" * 50
        cut = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert r["text"].encode() == cut or r["text"] == cut.decode("utf-8", "replace")
    copies = Counter(r["doc_id"] for r in kept[3].values())
    assert set(copies) <= set(texts) and max(copies.values()) <= 3
    assert Counter(r["doc_id"] for r in kept[4].values()) == copies
    final = Counter(map(str, entry.queries()["pipeline"](spark, small).collect()))
    assert final == Counter(str(r) for r in docs.collect())
