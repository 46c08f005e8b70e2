"""Exact and near duplicates, and the automata's and tiles' parts, against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gradeweave.llm import common, exact_dedup, simhash

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_fingerprint(text):
    words = [w for w in BLANKS.split(ascii_lower(text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def brute_components(prints, ids):
    values = np.array(prints, np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None]) <= 4
    label = np.arange(len(values))
    while True:
        now = np.array([label[row].min() for row in near])
        if (now == label).all():
            break
        label = now
    known = lambda c: [i for i, x in zip(ids, label) if x == c and i is not None]
    return [min(known(c), default=None) for c in label]


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_exact_groups(odd_docs, odd_rows, parts):
    plain = [BLANKS.sub("", r[1] or "") for r in odd_rows]
    groups = {}
    for row, key in zip(odd_rows, plain):
        groups.setdefault(key, []).append(row)
    order = lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)
    expected = []
    for key, rows in groups.items():
        rows.sort(key=order)
        for i, r in enumerate(rows):
            digest = hashlib.sha256(key.encode()).hexdigest()
            expected.append((r[0], rows[0][0], len(rows), i == 0, digest))
    got = [tuple(r) for r in exact_dedup.exact_groups(odd_docs, parts).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_exact_groups_empty(no_docs):
    assert exact_dedup.exact_groups(no_docs).collect() == []


def test_close_pairs_and_tiles():
    random = np.random.default_rng(5)
    values = random.integers(0, 2**63, 700, dtype=np.uint64)
    for i in range(200):
        flips = random.choice(64, random.integers(0, 8), replace=False)
        values[i + 300] = values[i] ^ np.uint64(sum(1 << int(b) for b in flips))
    distance = np.bitwise_count(values[:, None] ^ values[None])
    for radius in range(7):
        left, right = simhash.close_pairs(values, radius)
        assert sorted(zip(left, right)) == sorted(zip(*np.nonzero(np.triu(distance <= radius, 1))))
    assert [len(x) for x in simhash.close_pairs(values[:0])] == [0, 0]


def test_words_of_slices():
    """Words of a batch cut in slices, and of an array that is itself a slice."""
    texts = ["Ab é C", None, "", "ÖÄ 😀x\x0by z" * 50, " \x1c\u00a0 ", *[f"w{i} Ünï {i}" for i in range(400)]]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    split = lambda t: [w for w in BLANKS.split(ascii_lower(t or "")) if w]
    for most in (1, 50, 1000, 1 << 22):
        found, ids = [], []
        for part in common.by_bytes([batch.slice(3), batch.slice(0, 3)], most=most):
            words, counts = common.words_of(part.column("text"))
            ends = np.cumsum(counts)
            found += [words[e - c : e].to_pylist() for e, c in zip(ends.tolist(), counts.tolist())]
            ids += part.column("id").to_pylist()
        assert ids == [*range(3, len(texts)), 0, 1, 2] and found == [split(texts[i]) for i in ids]
    words, counts = common.words_of(batch.column("text").slice(200))
    assert words.to_pylist() == [w for t in texts[200:] for w in split(t)]


def check_near(docs, rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    roots = brute_components(prints, [r[0] for r in rows])
    expected = [(r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, roots)]
    got = [tuple(r) for r in simhash.near_groups(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_near_groups(odd_docs, odd_rows):
    check_near(odd_docs, odd_rows)


def test_near_groups_empty(no_docs):
    assert simhash.near_groups(no_docs).collect() == []
    assert simhash.one_of_each(no_docs).collect() == []


def test_large_buckets_and_long_chains(spark, monkeypatch):
    """One dense ball of fingerprints cut into chunks, and a chain that only its ends tell apart."""
    monkeypatch.setattr(simhash, "TILE", 16)
    random = np.random.default_rng(6)
    ball = [sum(1 << int(b) for b in random.choice(24, 2, replace=False)) for _ in range(120)]
    chain, value = [], 0x5A5A << 40
    for i in range(40):
        value ^= 0b1111 << (4 * (i % 9))
        chain.append(value ^ (i << 58))
    values = sorted(set(ball + chain))
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    distinct = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    found = simhash.components(simhash.links(distinct)).collect()
    roots = dict(zip(signed, signed)) | {r["a"]: r["root"] for r in found}
    expected = dict(zip(signed, brute_components(values, signed)))
    groups = lambda d: sorted(sorted(k for k in d if d[k] == c) for c in set(d.values()))
    assert groups(roots) == groups(expected)


def test_one_of_each(odd_docs, odd_rows):
    prints = [brute_fingerprint(r[1]) for r in odd_rows]
    label = brute_components(prints, list(range(len(odd_rows))))
    best = {}
    for c, r in zip(label, odd_rows):
        key = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        best[c] = min(best.get(c, (key, r)), (key, r), key=lambda x: x[0])
    got = simhash.one_of_each(odd_docs)
    assert got.columns == odd_docs.columns
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(r) for _, r in best.values())
