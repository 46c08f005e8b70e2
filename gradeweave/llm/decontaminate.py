"""Benchmark decontamination by template canonicalisation.

Words lose their case and outer punctuation; numbers, names and units become typed
placeholders. Windows of eight such words are hash-joined with the benchmark's, so a question
with other numbers or names is found too; what stands in the placeholders must then be a
consistent replacement, one new value for each old one, or the windows it stands in do not count. Windows with placeholders are also
joined by their plain words: an exact copy is found where too few words of it are literal, or
where other capitals or punctuation hide its names.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, coded, hashes, mixed, stored, words_of

WINDOW = 8
#: Items of fewer than WINDOW words are one window; of fewer than this, one of plain words only.
LEAST_WORDS = 5
#: Of a window's words so many, rounded up, must not be placeholders.
LITERAL_SHARE = 0.6
#: A document is contaminated by an item if this share of its windows, or this many, are found: 13
#: windows in a row are 20 words.
COVERAGE = 0.5
LONG_RUN = 13
#: Bits of the filter in front of the join: 1 MB whatever the benchmark's size.
FILTER_BITS = 23

# Punctuation around words, written numbers, units (short ones only after a number).
OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»¿¡…–—"
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
LONG_UNITS = (
    "kilometer kilometers kilometre kilometres meter meters metre metres centimeter centimeters "
    "mile miles inch inches feet yard yards kilogram kilograms gram grams pound pounds ounce ounces "
    "liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week "
    "weeks month months year years dollar dollars euro euros cent cents percent degree degrees"
).split()
SHORT_UNITS = "km m cm mm kg g mg lb lbs oz l ml s ms min h hr hrs mph kmh ft in yd usd eur gb mb kb".split()
NUMBER = r"^\d[\d.,:/]*$"
SENTENCE_END = r"[.!?:;][\"')\]”’»]*$"
CAPITALISED = r"^\p{Lu}.*\p{Ll}"

LITERAL, NUM, NAME, UNIT = range(4)
PLACEHOLDERS = {NUM: "<num>", NAME: "<name>", UNIT: "<unit>"}
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
WINDOW_SCHEMA = (
    "id bigint, text_key bigint, pos int, hash bigint, template string, slots array<string>, "
    "words int, whole string, variant string, plain boolean, templated boolean"
)


def canonical(texts: pa.Array):
    """(plain words, their kinds, hashes of words, of words or placeholders, words per text)."""
    words, counts = words_of(texts, lower=False)
    codes, distinct = coded(words)
    bare = pc.utf8_trim(distinct, characters=OUTER)
    plain = pc.utf8_lower(bare)
    flags = lambda found: found.to_numpy(zero_copy_only=False).astype(bool)
    number = flags(pc.or_(pc.match_substring_regex(bare, NUMBER), pc.is_in(plain, pa.array(NUMBER_WORDS, plain.type))))
    capital = flags(pc.match_substring_regex(bare, CAPITALISED))
    closing = flags(pc.match_substring_regex(distinct, SENTENCE_END))
    unit = flags(pc.is_in(plain, pa.array(LONG_UNITS, plain.type)))
    short = flags(pc.is_in(plain, pa.array(SHORT_UNITS, plain.type)))
    empty = flags(pc.equal(plain, ""))
    word_hash = hashes(plain)

    owner = np.repeat(np.arange(len(counts)), counts)
    opens = np.r_[True, closing[codes[:-1]] | (owner[1:] != owner[:-1])] if len(codes) else np.zeros(0, bool)
    after_number = np.r_[False, number[codes[:-1]]] & ~opens if len(codes) else opens
    kinds = np.zeros(len(codes), np.int8)
    kinds[capital[codes] & ~opens] = NAME
    kinds[unit[codes] | (short[codes] & after_number)] = UNIT
    kinds[number[codes]] = NUM
    keep = ~empty[codes]
    codes, kinds, owner = codes[keep], kinds[keep], owner[keep]
    exact = word_hash[codes]
    values = exact.copy()
    for kind in PLACEHOLDERS:
        values[kinds == kind] = np.uint64(kind)
    return plain, codes, kinds, exact, values, np.bincount(owner, minlength=len(counts))


def windows_of(kinds, exact, values, counts, width):
    """(start, owner, hash, plain, templated) of the windows of this width.

    A window is a template if enough of its words are literal; one with placeholders is one
    of plain words as well. Under LEAST_WORDS words, all are plain. `templated` tells whether its place has a template.
    """
    n = len(values) - width + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(bool), none.astype(bool)
    owner = np.repeat(np.arange(len(counts)), counts)
    literal = np.r_[0, np.cumsum(kinds == LITERAL)]
    literal = literal[width:] - literal[:n]
    short = width < LEAST_WORDS
    enough = (literal >= np.ceil(LITERAL_SHARE * width)) & (not short)
    inside = owner[:n] == owner[width - 1 :]
    parts = []
    for plain, chosen, hashed in ((False, inside & enough, values), (True, inside & ((literal < width) | short), exact)):
        start = np.flatnonzero(chosen)
        with np.errstate(over="ignore"):
            total = np.full(len(start), width, np.uint64)
            for i in range(width):
                total = total * MULTIPLIER + hashed[start + i]
        parts.append((start, owner[start], mixed(total), np.full(len(start), plain), enough[start]))
    return tuple(map(np.concatenate, zip(*parts)))


def digest_of(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def window_batches(widths, known=None, least=None):
    """A mapInArrow function: windows of (id, text_key, text) rows.

    With `known`, the filter's words, only windows that may be in it. Without, each text's
    own windows: of the first of `widths`, or the whole text if it is shorter.
    """

    def run(batches):
        for batch in by_bytes(batches):
            words, codes, kinds, exact, values, counts = canonical(batch.column("text"))
            firsts = np.cumsum(counts) - counts
            ids, keys = batch.column("id"), batch.column("text_key")
            texts = words.to_pylist() if known is None else None
            for width in widths:
                found = windows_of(kinds, exact, values, counts, width)
                start, owner, digest, plain, templated = found
                if known is None:
                    own = counts[owner] == width if width != widths[0] else counts[owner] >= width
                    start, owner, digest, plain, templated = (x[own] for x in found)
                else:
                    filt, mask = known.value, np.uint64((1 << FILTER_BITS) - 1)
                    for shift in (0, FILTER_BITS):
                        bit = (digest >> np.uint64(shift)) & mask
                        hit = (filt[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)
                        found = [x[hit == 1] for x in (start, owner, digest, plain, templated)]
                        start, owner, digest, plain, templated = found
                    if width < LEAST_WORDS:  # such a window is a whole item: once a text is enough
                        order = np.lexsort((digest, owner))
                        again = (np.diff(owner[order]) == 0) & (digest[order][1:] == digest[order][:-1])
                        once = np.sort(order[np.r_[True, ~again][: len(order)]])
                        start, owner, digest, plain, templated = (x[once] for x in found)
                if not len(start):
                    continue
                word = (lambda i: texts[codes[i]]) if texts else (lambda i: words[int(codes[i])].as_py())
                whole, variant = {}, {}
                if known is None:
                    patterned = set(owner[templated].tolist())
                    for o in np.unique(owner).tolist():
                        span = range(firsts[o], firsts[o] + counts[o])
                        marks = PLACEHOLDERS if o in patterned else {}
                        said, seen = [word(i) for i in span], {}
                        # Which slots hold one value, whatever it is.
                        alike = [seen.setdefault(w, len(seen)) for i, w in zip(span, said) if kinds[i] in marks]
                        text = " ".join(marks.get(kinds[i], w) for i, w in zip(span, said))
                        whole[o] = digest_of(f"{text}\n{alike}")
                        variant[o] = digest_of(f"{' '.join(said)}\n{kinds[span.start : span.stop].tolist()}")
                template, slots = [], []
                for s, as_is in zip(start.tolist(), plain.tolist()):
                    own = [(LITERAL if as_is else kinds[i], word(i)) for i in range(s, s + width)]
                    template.append(" ".join(PLACEHOLDERS.get(k, w) for k, w in own))
                    slots.append([w for k, w in own if k])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(owner)),
                        keys.take(pa.array(owner)),
                        pa.array((start - firsts[owner]).astype(np.int32)),
                        pa.array(digest.view(np.int64)),
                        pa.array(template, pa.string()),
                        pa.array(slots, pa.list_(pa.string())),
                        pa.array(counts[owner].astype(np.int32)),
                        pa.array([whole.get(o) for o in owner.tolist()], pa.string()),
                        pa.array([variant.get(o) for o in owner.tolist()], pa.string()),
                        pa.array(plain),
                        pa.array(templated),
                    ],
                    ["id", "text_key", "pos", "hash", "template", "slots", "words", "whole", "variant", "plain", "templated"],
                )

    return run


def text_rows(table: DataFrame, key: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return table.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of the items; items of one template are reported as one, under their smallest item_id.

    Items are of one template if their texts with placeholders are the same and the same of their
    slots hold equal values. Rows that repeat a text count once; a null item_id is passed on where
    the item has no other. Each text of it is a variant with windows and slot values of its own.
    `windows` counts the item's places, `templates` those of them that have a template. Items
    without a template are one only if all their words agree.
    """
    widths = list(range(WINDOW, 0, -1))
    rows = text_rows(benchmark, "item_id").mapInArrow(window_batches(widths), WINDOW_SCHEMA)
    rows = stored(rows, "benchmark-windows")
    first = rows.groupBy("whole").agg(F.min("id").alias("item_id"))
    # The items whose own text a variant is.
    members = rows.groupBy("variant").agg(F.array_sort(F.collect_set("id")).alias("item_ids"))
    own = rows.drop("id", "text_key").distinct().join(first, "whole").join(members, "variant")
    templates = F.count_if(~F.col("plain")).over(Window.partitionBy("variant")).cast("int")
    windows = F.greatest(F.col("words") - WINDOW + 1, F.lit(1)).alias("windows")
    columns = ["item_id", "item_ids", "variant", "pos", "hash", "template", "slots", "words", "plain", "templated"]
    return stored(own.select(*columns, windows, templates.alias("templates")), "item-windows")


def window_filter(windows: DataFrame) -> np.ndarray:
    """A Bloom filter of the windows' hashes; its size, 2^17 words, does not depend on them."""
    mask = (1 << FILTER_BITS) - 1
    bits = [F.shiftrightunsigned("hash", s).bitwiseAND(mask) for s in (0, FILTER_BITS)]
    word = windows.select(F.explode(F.array(*bits)).alias("bit")).select(
        F.shiftright("bit", 6).cast("int").alias("word"),
        F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("mask"),
    )
    found = word.groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    filt = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    filt[found["word"].to_numpy()] = found["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return filt


def found_items(docs: DataFrame, benchmark: DataFrame, coverage=COVERAGE, long_run=LONG_RUN) -> DataFrame:
    """A row per contaminated document and item.

    doc_id, text_key, item_id, matched and windows (of the item), coverage (of all its windows
    or of those with a template, whichever is more), slots (distinct values in the item's
    placeholders that were matched), slots_changed (those that are another value in the
    document) and item_ids: of all items of the template, those whose own text comes nearest to
    the document. item_id is null, and item_ids empty, for items without one. Null and empty texts match
    nothing; items of under five words match where all their words stand in a row. Repeated rows, equal in doc_id and text, give one; other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark_windows(benchmark)
    short = [r[0] for r in items.where(F.col("words") < WINDOW).select("words").distinct().collect()]
    known = spark.sparkContext.broadcast(window_filter(items))
    rows = text_rows(docs, "doc_id").mapInArrow(window_batches([WINDOW, *short], known), WINDOW_SCHEMA)
    rows = rows.select(F.col("id").alias("doc_id"), "text_key", F.col("pos").alias("doc_pos"), "template", F.col("slots").alias("doc_slots"))
    met = rows.join(items, "template")
    pair = F.arrays_zip(F.col("slots").alias("old"), F.col("doc_slots").alias("new"))
    key = ["doc_id", "text_key", "item_id", "variant"]
    # One placing of the item in the document: a shift. Replacements must be consistent in it: an
    # old value with two new ones takes the windows with placeholders it stands in, and no others.
    # Windows without placeholders and those of plain words agree word for word, and stay.
    met = met.withColumn("window", F.struct("pos", "plain", "templated", pair.alias("pairs")))
    shifts = met.groupBy(*key, (F.col("doc_pos") - F.col("pos")).alias("shift")).agg(
        F.max("windows").alias("windows"),
        F.max("templates").alias("templates"),
        F.first("item_ids").alias("item_ids"),
        F.collect_set("window").alias("met"),
    )
    shifts = shifts.withColumn("pairs", F.array_distinct(F.flatten("met.pairs")))
    shifts = shifts.withColumn("old", F.array_distinct("pairs.old"))
    times = F.transform("old", lambda o: F.struct(o.alias("old"), F.size(F.filter("pairs", lambda p: p["old"] == o)).alias("new")))
    torn = F.filter(times, lambda t: t["new"] > 1)["old"]
    shifts = shifts.withColumn("torn", F.when(F.size("pairs") > F.size("old"), torn).otherwise(F.array().cast("array<string>")))
    kept = F.filter("met", lambda w: ~F.arrays_overlap(w["pairs"]["old"], F.col("torn")))
    lost = F.filter("met", lambda w: F.arrays_overlap(w["pairs"]["old"], F.col("torn")))
    shifts = shifts.withColumn("kept", kept).withColumn("lost", lost).where(F.size("kept") > 0)
    changed = F.array_distinct(F.filter("pairs", lambda p: p["old"] != p["new"])["old"])
    shifts = shifts.select(
        *key,
        "windows",
        "templates",
        "item_ids",
        F.array_distinct("kept.pos").alias("at"),
        # Where a template was lost, its place counts among all of the item's, not among those with one.
        F.array_except(F.filter("kept", lambda w: w["templated"])["pos"], F.col("lost.pos")).alias("at_templates"),
        F.size("old").alias("slots"),
        F.size(changed).alias("slots_changed"),
    )
    places = lambda name: F.size(F.array_distinct(F.flatten(F.collect_list(name))))
    found = shifts.groupBy(*key).agg(
        F.max("windows").alias("windows"),
        F.max("templates").alias("templates"),
        places("at").alias("matched"),
        places("at_templates").alias("_matched_templates"),
        F.max("slots").alias("slots"),
        F.min("slots_changed").alias("slots_changed"),
        F.first("item_ids").alias("item_ids"),
    )
    of_templates = F.try_divide("_matched_templates", "templates")
    most = F.greatest(F.col("matched") / F.col("windows"), of_templates)
    found = found.withColumn("coverage", most).drop("templates", "_matched_templates")
    found = found.where((F.col("coverage") >= coverage) | (F.col("matched") >= long_run))
    # Of an item's variants, the one that is nearest to the document.
    values = [c for c in found.columns if c not in key]
    near = F.struct("coverage", "matched", (-F.col("slots_changed")).alias("same"), *[c for c in values if c not in ("coverage", "matched")])
    best = found.groupBy(*key[:-1]).agg(F.max(near).alias("best"))
    return best.select(*key[:-1], *[F.col("best")[c].alias(c) for c in values])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that no item contaminates."""
    hit = stored(found_items(docs, benchmark).select("doc_id", "text_key").distinct(), "contaminated")
    text_key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    same = docs["doc_id"].cast("bigint").eqNullSafe(hit["doc_id"]) & (text_key == hit["text_key"])
    return docs.join(hit, same, "left_anti")
