"""Seekable frames and the fill-in-middle form, against the contract in plain Python."""

import hashlib
import random
import re

import pytest
import zstandard

from conftest import SCHEMA, prose
from gradeweave.llm import queries, seekable

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
compress = zstandard.ZstdCompressor().compress


def brute(key, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, n)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, n, "plain", None, None, text, text
    if h[3] % 100 < 80:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_cuts_in_frames_of_any_size(size):
    draw = random.Random(size)
    for _ in range(800):
        text = "".join(draw.choice("ab é😀 \n\t<P>\x1c ") for _ in range(draw.randrange(1, 40)))
        units = UNITS.findall(text)
        frames = seekable.frames_of(text.encode(), compress, size)
        assert frames[1][-1] == len(units) and frames[2][-1] == len(text)
        assert b"".join(zstandard.decompress(f) for f in frames[0]).decode() == text
        low = draw.randrange(len(units) + 1)
        high = draw.randrange(low, len(units) + 1)
        p, m, s = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, len(units))))
        for form, expected in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}")):
            prefix, middle, output = seekable.formed(form, low, high, *frames, compress)
            assert (prefix, middle) == (len(p), len(m))
            assert b"".join(seekable.stream(seekable.Reader(output))).decode() == expected
            if not any(x in text for x in ("<P>", "<S>", "<M>")):
                assert b"".join(seekable.restored(output, form)).decode() == text


def test_only_cut_frames_are_opened():
    """The other frames of a long text come out as the same bytes."""
    frames = seekable.frames_of(prose(1, 40_000).encode(), compress, 4096)
    _, _, output = seekable.formed("psm", 9_000, 30_000, *frames, compress)
    kept = [f for f in output if f in frames[0]]
    assert len(kept) == len(frames[0]) - 2


def odd(rows):
    texts = ["a <P> b", "x <M", "P> y", "one", " ", "a b c", "<<P", "end \n"] + [prose(i, 9 + i) + "é" for i in range(60)]
    return [*rows, *[(5000 + i, t, "en", "a", 0, *([None] * 16)) for i, t in enumerate(texts)]]


def test_texts_and_digests(spark, odd_rows, no_docs):
    rows = odd(odd_rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    expected = sorted(str(brute(r[0], r[1])) for r in rows)
    for size in (64, seekable.FRAME_BYTES):
        formed = seekable.fill_in_middle(seekable.text_frames(docs, frame_bytes=size))
        assert sorted(str(tuple(r)) for r in seekable.with_texts(formed).collect()) == expected
    assert {r.split("'")[1] for r in expected} == {"plain", "psm", "spm"}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    digests = [(*b[:5], sha(b[5]), sha(b[6])) for b in (brute(r[0], r[1]) for r in rows)]
    report = seekable.fim_report(docs)
    assert report.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert sorted(map(str, map(tuple, report.collect()))) == sorted(map(str, digests))
    assert seekable.fim_report(no_docs).collect() == []


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = queries.op13_seekable_fim(spark, "/root/testdata/sf0.001").collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    expected = [brute(r["doc_id"], r["text"]) for r in docs]
    expected = [(*b[:5], sha(b[5]), sha(b[6])) for b in expected]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))
