"""Shards, mixes, rollups, licenses, leaks and the pipeline."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from check_oracles import connect, differences
from conftest import prose
from test_duplicates import brute_components, brute_fingerprint
from gradeweave.llm import decontaminate, language, licences, mixing, oracles, queries, sharding, simhash, token_rollup

SF_DIR = "/root/testdata/sf0.001"


def brute_jump(key, shards):
    key, at, jump = (key or 0) % 2**64, -1, 0
    while jump < shards:
        at = jump
        key = (key * 2862933555777941757 + 1) % 2**64
        jump = int((at + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return at


def test_jump_shard(spark):
    keys = [0, 1, 2, 63, 64, 2**62, -1, -(2**63), 2**63 - 1, None, *range(1000, 1400)]
    docs = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    for shards in (1, 2, 8, 9, 64, 65, 1000):
        got = sharding.assign_shards(docs, shards).collect()
        assert [r["shard"] for r in got] == [brute_jump(r["doc_id"], shards) for r in got]
    with pytest.raises(ValueError):
        sharding.assign_shards(docs, 0)
    text_keys = sharding.assign_shards(docs.selectExpr("string(doc_id) doc_id"), 5)
    assert set(range(5)) == {r["shard"] for r in text_keys.collect()}


def test_shard_layout(odd_docs, odd_rows, no_docs):
    got = sharding.shard_layout(odd_docs, 8).collect()
    expected = [(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), brute_jump(r[0], 8), brute_jump(r[0], 9)) for r in odd_rows]
    mine = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got]
    assert sorted(map(str, mine)) == sorted(map(str, expected))
    for shard in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_layout(no_docs, 8).collect() == []


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Fill up by weight, again and again, until no source is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= most * sizes[s]}
        for s in full or open_:
            target[s] = most * sizes[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    return target


def test_mix(odd_docs, odd_rows, no_docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += size(r[1])
    target = brute_targets(sizes)
    source = {r[0]: r[3] for r in odd_rows}
    got = mixing.mix_report(odd_docs).collect()
    assert len(got) == len(odd_rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[source[r["doc_id"]]]
        assert math.isclose(r["target"], target[source[r["doc_id"]]], rel_tol=1e-9)
        rate = r["target"] / r["source_size"]
        assert r["copies"] in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9)) and r["taken"] == r["copies"] * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    largest = {s: max(size(r[1]) for r in odd_rows if r[3] == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    again = mixing.mix_report(odd_docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns
    words = Counter(r["source"] for r in mixed.collect() for _ in range(size(r["text"])))
    assert all(abs(words[s] - target[s]) <= largest[s] for s in sizes)
    assert mixing.mix(no_docs).collect() == [] == mixing.mix_report(no_docs).collect()


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql(spark, name):
    got = queries.registry()[name](spark, SF_DIR).toPandas()
    assert differences(got, connect(SF_DIR).execute(oracles.oracle_sql()[name]).df()) == ""


def test_rollup_batches(spark, tmp_path):
    path = str(tmp_path / "rollup")
    rows = lambda *r: spark.createDataFrame(r, "source string, lang string, version string, docs long, tokens long")
    first = rows(("a", None, "v1", 2, 10), (None, "en", "v1", 1, 5), ("a", None, "v1", 1, 1))
    token_rollup.commit(path, "one", first)
    token_rollup.commit(path, "one", first)
    token_rollup.commit(path, "two", rows(("a", None, "v1", -1, -4), (None, "en", "v1", -1, -5)))
    got = sorted(map(str, map(tuple, token_rollup.totals(spark, path).collect())))
    assert got == [str(("a", None, "v1", 2, 7, 2))]


def test_rollup_recommit_without_rows(spark, tmp_path):
    """A batch committed again replaces what it had, also when it has nothing left."""
    path = str(tmp_path / "rollup")
    rows = lambda *r: spark.createDataFrame(r, "source string, lang string, version string, docs long, tokens long")
    token_rollup.commit(path, "a/b=c", rows(("a", None, "v1", 2, 10)))
    token_rollup.commit(path, "two", rows(("a", None, "v1", 1, 5)))
    token_rollup.commit(path, "a/b=c", rows(("a", None, "v1", 2, 10)).limit(0))
    assert [tuple(r) for r in token_rollup.totals(spark, path).collect()] == [("a", None, "v1", 1, 5, 1)]


def test_shard_slots_of_one_hot_key(spark):
    """The rows of one key are numbered over many strata, and still without gaps."""
    docs = spark.range(20_000).selectExpr("cast(null as long) doc_id", "concat('text ', id) text")
    got = sharding.shard_layout(docs, 8)
    assert sorted(r["slot"] for r in got.collect()) == list(range(20_000))
    assert got.select("shard").distinct().count() == 1


def test_mix_of_one_hot_row_and_many_sources(spark):
    """A row with more copies than a block, beside sources enough for several ranges."""
    docs = spark.range(12_000).selectExpr(
        "if(id < 9000, 1, id) doc_id", "if(id < 9000, 'same words here', concat('w ', id)) text",
        "if(id < 9000, 's', concat('s', id % 700)) source")
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(r["text"].split())
    target = brute_targets(sizes)
    report = mixing.mix_report(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    assert all(math.isclose(r["target"], target[source[r["doc_id"]]], rel_tol=1e-9) for r in report)
    mixed = Counter()
    for r in mixing.mix(docs).collect():
        mixed[r["source"]] += len(r["text"].split())
    assert all(abs(mixed[s] - target[s]) <= 3 for s in sizes)


def test_rollup_odd(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(5, 1), (5, 1), (6, 0), (9, 1)], "doc_id long, toxic int")
    got = token_rollup.documents_rollup(odd_docs, labels).collect()
    assert sum(r["docs"] for r in got) == odd_docs.where("coalesce(doc_id, -1) not in (5, 9)").count()
    assert token_rollup.documents_rollup(no_docs, labels).collect() == []


def test_licenses(spark, no_docs):
    notice = licences.TEMPLATES["mit-notice"]
    changed = notice.replace("free of charge", "for nothing at all").replace("merge, ", "")
    lines = licences.TEMPLATES["mit"]
    texts = [None, "", "é " + lines + " tail", lines.upper() + "\n" + lines, prose(3, 50) + " " + changed + " end", prose(4, 900)]
    texts += ["the MIT License", prose(5, 30_000) + " " + licences.TEMPLATES["cc-by-nc-4.0"]]
    # The first shares five of seven words with the second, and is one place of one license.
    texts += [licences.TEMPLATES["gpl-3.0"] + " " + prose(6, 9) + " " + licences.TEMPLATES["apache-2.0"], licences.TEMPLATES["apache-2.0-notice"]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licences.find_licenses(docs).collect()
    found = Counter((r["doc_id"], r["license"]) for r in got)
    assert found == {(2, "mit"): 1, (3, "mit"): 2, (4, "mit-notice"): 1, (7, "cc-by-nc-4.0"): 1, (8, "gpl-3.0"): 1, (8, "apache-2.0"): 1, (9, "apache-2.0-notice"): 1}
    for r in got:
        part = texts[r["doc_id"]][r["start"] : r["end"]]
        if r["license"] == "mit":
            assert part.lower() == lines.lower().rstrip(".") and r["coverage"] == 1.0
        elif r["license"] == "mit-notice":
            assert part.startswith("Permission") and part.endswith("to do so") and 0.7 < r["coverage"] < 1
    assert licences.find_licenses(no_docs).collect() == []


LINES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "mit": "Released under the MIT License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "proprietary": "All rights reserved.",
}


def test_license_lines(spark):
    """Each license line of the given documents is found in every document that holds it."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = [(r["doc_id"], set((r["text"] or "").splitlines())) for r in docs.collect()]
    expected = {name: Counter(d for d, lines in rows if line in lines) for name, line in LINES.items()}
    got = licences.find_licenses(docs).collect()
    assert all(expected.values())
    assert {name: Counter(r["doc_id"] for r in got if r["license"] == name) for name in LINES} == expected


def test_short_license(spark):
    """Three words are one gram, which winnowing may pass over; every place is found."""
    line = LINES["proprietary"]
    texts = [prose(i, 5) + " " + line + " " + prose(i + 50, i % 7) for i in range(50)]
    texts += [line, line + " " + line, f"({line.upper()})", "all rights not reserved", "rights reserved"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = licences.find_licenses(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter([*range(53), 51])
    assert {texts[r["doc_id"]][r["start"] : r["end"]].lower() for r in got} == {"all rights reserved"}


def full_alignment(template, words):
    """Matched words of the best local alignment, over the whole table of both texts."""
    best, above = (0.0, 0), [(0.0, 0)] * (len(words) + 1)
    for word in template:
        row = [(0.0, 0)]
        for j, other in enumerate(words, 1):
            score, matched = max(above[j - 1], (0.0, 0)) if above[j - 1][0] > 0 else (0.0, 0)
            same = word == other
            ways = [(score + (1 if same else licences.MISS), matched + same)]
            ways += [(s + licences.GAP, m) for s, m in (above[j], row[j - 1])]
            row.append(max(ways))
            best = max(best, row[j])
        above = row
    return best[1]


def test_license_texts_altered():
    """Every notice of 20 words or more, whole and with 5, 10 and 15 of 100 words changed, inside other text."""
    index = licences.Index(licences.TEMPLATES)
    random = np.random.default_rng(3)
    long = {n: t for n, t in licences.TEMPLATES.items() if len(index.words[n]) >= 20}
    for name, template in long.items():
        for share in (0.0, 0.05, 0.10, 0.15):
            words = template.split()
            for i in np.flatnonzero(random.random(len(words)) < share).tolist():
                words[i] = ("", f"w{i}", f"{words[i]} x{i}")[random.integers(3)]
            copy = "\n * ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
            text = prose(11, 40) + "\n" + copy + "\n" + prose(12, 40)
            found = licences.found_in(text, index, licences.COVERAGE)
            assert [f[0] for f in found] == [name], (name, share, found)
            start, end, matched = found[0][1:4]
            assert start >= text.index("\n") and end <= len(text) - len(prose(12, 40))
            assert matched == full_alignment(index.words[name], licences.plain_words(text)[0])


ITEM = "A train leaves Berlin for Paris with 120 people and after 45 minutes another 120 people board the train how many people"
SHORT = "name the largest planet we know today"


def leak_docs(spark):
    other = ITEM.replace("Berlin", "Madrid").replace("Paris", "Lisbon").replace("120", "77").replace("45", "30")
    uneven = ITEM.replace("120", "77", 1)
    texts = [None, "", ITEM, "before it. " + ITEM.upper() + " and after", prose(1, 300) + ". " + other, prose(2, 40) + " " + uneven]
    texts += [prose(3, 500), SHORT + " " + prose(4, 30), " ".join(ITEM.split()[:6]), ITEM.replace(" ", "!! ")]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, ITEM), (None, ITEM)]
    bench = [(1, ITEM), (2, SHORT), (3, "too short"), (4, None), (5, ITEM.replace("120", "99"))]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")


def test_leaks(spark, no_docs):
    docs, bench = leak_docs(spark)
    docs = docs.withColumn("hash", F.lit(1)).withColumn("id", F.lit("x"))
    got = decontaminate.found_items(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    # Upper case hides names, but not the words; other values are found if consistent.
    assert found == {(2, 1), (3, 1), (4, 1), (None, 1), (7, 2), (9, 1)}
    by = {r["doc_id"]: r for r in got}
    assert by[2]["slots_changed"] == 0 and by[2]["coverage"] == 1.0 and by[4]["slots_changed"] >= 3
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {0, 1, 5, 6, 8}
    assert decontaminate.found_items(no_docs, bench).collect() == []
    assert decontaminate.clean_documents(docs, bench.limit(0)).count() == docs.count()


def found_pairs(spark, texts, bench, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontaminate.found_items(docs, items, **options).collect()}


APPLES = "the farmer who lives alone has {} apples and buys {} pears before going home to bake one cake"
#: Names stand too close for templates in the second half: it is found by its plain words only.
ROWS = "she then counts {} apples for the long way and asks {} and Anna and Berta and Carla and Dora and Emma and Frieda and Gerda and Hanna"


def test_leaks_of_one_template(spark):
    """Every item of a template is found in its own copies, with its own values."""
    bench = [(1, APPLES.format(5, 5)), (2, APPLES.format(3, 4)), (3, ROWS.format(5, "Zoe")), (4, ROWS.format(6, "Yan"))]
    texts = [prose(i, 40) + " " + text + " " + prose(i + 9, 40) for i, (_, text) in enumerate(bench)]
    texts += [APPLES.format(8, 9), bench[3][1].split(" way ")[1]]
    got = found_pairs(spark, texts, bench)
    # 5 and 5 may stand for 3 and 4; 3 and 4 not for 5 and 5. Items 3 and 4 are one.
    assert set(got) >= {(0, 1), (0, 2), (1, 2), (2, 3), (3, 3), (4, 2), (5, 3)}
    # Of the items of one template, the one whose own words the document holds is named.
    assert [got[pair]["item_ids"] for pair in [(0, 1), (1, 2), (2, 3), (3, 3)]] == [[1], [2], [3], [4]]
    assert {d for d, _ in got} == set(range(6))
    assert all(got[pair]["coverage"] == 1.0 and got[pair]["slots_changed"] == 0 for pair in [(0, 1), (1, 2), (2, 3), (3, 3)])


def test_leaks_with_one_change(spark):
    """A repeated value that is changed once takes the windows it stands in, not those that match."""
    tail = " ".join(f"{w}{i}x" for i, w in enumerate(prose(5, 45).split()))
    item = "first put 12 of the red balls in one box and then " + tail + " and add 12 of the others"
    texts = [item.replace("12", "15", 1), item[::-1].replace("21", "51", 1)[::-1], item.replace(" 12 ", " 15 ")]
    texts += ["first put 15 of the red balls in one box and add 12 of the others"]
    got = found_pairs(spark, [prose(1, 20) + " " + t for t in texts], [(1, item)])
    places = len(item.split()) - 7
    # Of the windows, those with the changed number are lost, and those only.
    assert {pair: r["matched"] for pair, r in got.items()} == {(0, 1): places - 3, (1, 1): places - 4, (2, 1): places}
    assert got[2, 1]["slots_changed"] == 1 and all(r["windows"] == places for r in got.values())


def test_leaks_of_odd_rows(spark):
    """Items without an id are found; a repeated row of the benchmark changes nothing."""
    few = ROWS.format(6, "Yan")
    other = few.replace("6", "8")
    once = [(1, few), (None, ITEM), (None, SHORT)]
    texts = [prose(1, 20) + " " + t for t in (few, other.split(" and Carla")[0], ITEM, SHORT + " " + ITEM)]
    got = found_pairs(spark, texts, once)
    assert set(got) == {(0, 1), (1, 1), (2, None), (3, None)}
    again = found_pairs(spark, texts, once * 5 + [(7, few)] * 3)
    values = lambda found: {k: {**r.asDict(), "item_ids": None} for k, r in found.items()}
    assert values(again) == values(got)
    assert got[0, 1]["item_ids"] == [1] and again[0, 1]["item_ids"] == [1, 7] and got[2, None]["item_ids"] == []


def test_leaks_of_short_items(spark):
    """Items of any number of words are found as whole word sequences."""
    bench = [(n, " ".join(["Seven", "12", "swans,", "swim", "in", "Bath", "at", "noon"][:n])) for n in range(1, 9)] + [(9, "!!"), (10, "swim swim")]
    texts = [f"{prose(1, 9)} {text}, {prose(2, 9)} {text}" for _, text in bench] + ["twelve swans swim", "", None, "SEVEN", "seventh 12 swans"]
    got = found_pairs(spark, texts, bench)
    assert {(d, i) for d, i in got if i < 5 or i > 8} == {(d, i) for d in range(8) for i in range(1, 5) if i <= d + 1} | {(9, 10), (13, 1)}
    assert {(n - 1, n) for n in range(5, 9)} <= set(got)
    assert all(r["coverage"] == 1.0 and r["matched"] == 1 and r["windows"] == 1 for r in got.values())


def test_leaks_without_literals(spark):
    """Items of numbers and names alone have no template: exact copies are found, and only those."""
    sums = ["12 + 34 = 46 and 7 * 8 = 56 minus 10 20 30 40", "12 + 35 = 47 and 7 * 8 = 56 minus 11 21 31 41"]
    names = "the Anna Berta Carla Dora Emma Frieda Gerda Hanna Ida"
    bench = spark.createDataFrame(list(enumerate([*sums, names])), "item_id long, text string")
    texts = [prose(1, 50) + " " + sums[1] + " " + prose(2, 50), names.lower() + " " + prose(3, 20), sums[0].replace("4", "9")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.found_items(docs, bench).collect()}
    assert got == {(0, 1), (1, 2)}


def test_leaks_in_documents(spark):
    """Every document that holds a whole item is found, and no other."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").toPandas()
    expected = {(d, i) for d, t in zip(docs.doc_id, docs.text) for i, x in zip(bench.item_id, bench.text) if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op9_benchmark_leaks(spark, SF_DIR).collect()}
    assert expected <= got and len(got - expected) <= 2


def test_pipeline(spark):
    """Each stage's rows against what its operator says of its own input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, SF_DIR), name)
        ids = Counter(r["doc_id"] for r in out.collect())
        before = Counter(r["doc_id"] for r in docs.collect())
        if name == "language_id":
            und = {r["doc_id"] for r in language.train_and_predict(docs).where("lang_pred = 'und'").collect()}
            assert ids == Counter({i: n for i, n in before.items() if i not in und})
        elif name == "near_dedup":
            groups = {r["component_id"] for r in simhash.near_groups(docs).collect()}
            assert len(ids) == len(groups) and max(ids.values()) == 1
        elif name == "decontamination":
            leaks = {r["doc_id"] for r in decontaminate.found_items(docs, bench).collect()}
            assert leaks and set(ids) == set(before) - leaks
        elif name == "source_mix":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(docs).collect() if r["copies"]}
            assert set(ids) <= set(before) and max(ids.values()) <= 3 and abs(sum(copies.values()) - out.count()) <= 40
        else:
            assert ids == before
            assert all(r["shard"] == brute_jump(r["doc_id"], 8) and r["grown_shard"] == brute_jump(r["doc_id"], 9) for r in out.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = out
    assert entry.queries()["pipeline"](spark, SF_DIR).count() == docs.count()


def test_pipeline_odd(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, SF_DIR), name)
        assert {"shard", "grown_shard"} <= set(docs.columns)


def brute_pipeline(rows, items):
    """(doc_id, text, lang, source, shard, grown_shard) of the pipeline's rows, one stage after another in plain Python."""
    bare = lambda t: " ".join(w for w in (x.strip(decontaminate.OUTER).lower() for x in (t or "").split()) if w)
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best = {}
    for c, r in zip(brute_components([brute_fingerprint(r[1]) for r in rows], list(range(len(rows)))), rows):
        best[c] = min(best.get(c, r), r, key=lambda x: (-len(x[1]), x[0]))
    said = [f" {bare(t)} " for t in items if bare(t)]
    rows = [r for r in best.values() if not any(t in f" {bare(r[1])} " for t in said)]
    size = {r[0]: len(r[1].split()) for r in rows}
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size[r[0]]
    out = Counter()
    for source, target in brute_targets(sizes).items():
        own = sorted((r for r in rows if r[3] == source), key=lambda r: size[r[0]])
        assert len({size[r[0]] for r in own}) == len(own) and max(size.values()) < 128  # the order is by size alone
        rate = target / sizes[source]
        digest = hashlib.md5(f"{mixing.SEED}|{'true' if source is None else 'false'}{source or ''}".encode()).hexdigest()
        shift = int(digest[: mixing.OFFSET_DIGITS], 16) / 16**mixing.OFFSET_DIGITS
        for i, r in enumerate(own):
            n = math.floor((i + 1) * rate + shift) - math.floor(i * rate + shift)
            out[(*r, brute_jump(r[0], 8), brute_jump(r[0], 9))] += n
    return +out


def test_pipeline_by_brute_force(spark, tmp_path):
    """The pipeline's rows against all its stages in plain Python."""
    items = [(1, APPLES.format(5, 5)), (2, APPLES.format(3, 4)), (3, ROWS.format(5, "Zoe")), (4, ROWS.format(6, "Yan"))]
    items += [(5, "Quokka Island"), (None, ITEM), (6, None), (1, APPLES.format(5, 5))]
    texts = [prose(100 + i, 20 + i) for i in range(50)]
    texts += [f"{prose(i, 9 + i)}. {t} {prose(i + 60, 7)}" for i, (_, t) in enumerate(items) if t]
    texts += [texts[3].upper(), f" {texts[8]}\n", texts[20], None, "", "12 34", "!?"]
    rows = [(i, t, ("en", "de")[i % 2], ("a", "b", None, "é", "c")[i * i % 7 % 5]) for i, t in enumerate(texts)]
    rows += [rows[5]] * 3
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    expected = brute_pipeline(rows, [t for _, t in items])
    assert got == expected and len(expected) > 20
