"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint is cut into six blocks of bits. Fingerprints that differ in at most four bits
agree in two blocks at least, so each distinct fingerprint goes, once per pair of blocks,
into the bucket of these blocks' values. Inside a bucket, fingerprints are stored as 64 bit
planes; the distances of one fingerprint to 64 others are counted per machine word with
carry-save counters, and a comparison ends once all counters have passed the radius.
Links become components by rounds of hooking to the smallest neighbour.
"""

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import by_bytes, row_key, rows_once, stored, words_of

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fixed values of the index: widths of the blocks, from the lowest bit, 64 in sum.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints compared at a time; larger buckets are cut into chunks of this size.
TILE = 2048
QUERIES = 256
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
EDGE_SCHEMA = "a bigint, b bigint"


def fingerprint_of(words: list, width: int = SHINGLE) -> int:
    """Fingerprint of a text's words: a bit is set if more than half of the shingles' hashes set it."""
    if not words:
        return 0
    joined = " ".join(words).encode()
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    if len(joined) != int(lengths.sum()) + len(words) - 1:  # not only ASCII
        lengths = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    count = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    until = ends[-count:].tolist()
    values = [digest(joined[s:e], SEED) for s, e in zip(starts[:count].tolist(), until)]
    total = np.zeros(64, np.int64)
    for at in range(0, count, 1 << 16):  # a long text is counted in pieces
        piece = np.array(values[at : at + (1 << 16)], np.uint64)
        bits = np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * total > count))


def fingerprint_batches(batches):
    for batch in by_bytes(batches):
        words, counts = words_of(batch.column("text"))
        known = {}  # copies in a batch are hashed once
        values, at = [], 0
        for count in counts.tolist():
            own = words.slice(at, count).to_pylist()
            at += count
            key = hashlib.blake2b(" ".join(own).encode(), digest_size=16).digest()
            if key not in known:
                known[key] = fingerprint_of(own)
            values.append(known[key])
        signed = np.array(values, np.uint64).view(np.int64)
        carried = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [*map(batch.column, carried), pa.array(signed)], [*carried, "fingerprint"]
        )


def fingerprints(docs: DataFrame, *carried) -> DataFrame:
    """The carried columns and the 64-bit fingerprint (as a signed number) of each document."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *carried, "text")
    schema = rows.drop("text").schema.add("fingerprint", LongType())
    return rows.mapInArrow(fingerprint_batches, schema)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Plane p holds bit p of all values, 64 values to a word; the last word is filled up with zeros."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def close_pairs(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All i < j whose values differ in at most `radius` bits (radius below 7)."""
    n = len(values)
    planes = bit_planes(values)
    words = planes.shape[1]
    order = np.arange(words * 64).reshape(words, 64)
    left, right = [], []
    for first in range(0, n, QUERIES):
        rows = np.arange(first, min(first + QUERIES, n))
        skip = first // 64  # words before hold earlier values only
        # A pair counts once: later values only, and no filling.
        closed = (order[skip:][None] <= rows[:, None, None]) | (order[skip:][None] >= n)
        over = np.packbits(closed, axis=2, bitorder="little").view(np.uint64)[:, :, 0]
        one, two, four = (np.zeros_like(over) for _ in range(3))
        mine = values[rows]
        for p in range(64):
            flip = np.uint64(0) - ((mine >> np.uint64(p)) & np.uint64(1))
            differs = planes[p, skip:][None] ^ flip[:, None]
            # Carry-save: the plane's bits go into a counter of three bits per comparison.
            carry = one & differs
            one ^= differs
            higher = two & carry
            two ^= carry
            over |= four & higher  # past 7
            four ^= higher
            if p % 8 == 7:
                # Over the radius once the count exceeds it; such comparisons stay closed.
                over |= exceeds(one, two, four, radius)
                live = (over != FULL).any(axis=1)
                if not live.any():
                    rows = rows[:0]
                    break
                if live.sum() * 2 < len(live):  # the blocks that are all past it are left
                    rows, mine, over = rows[live], mine[live], over[live]
                    one, two, four = one[live], two[live], four[live]
        if len(rows):
            inside = np.unpackbits((~over).view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
            q, j = np.nonzero(inside)
            left.append(rows[q])
            right.append(j + skip * 64)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def exceeds(one, two, four, radius: int):
    """Where the three-bit count is greater than the radius."""
    greater, equal = np.zeros_like(one), np.full_like(one, FULL)
    for plane, bit in ((four, radius >> 2 & 1), (two, radius >> 1 & 1), (one, radius & 1)):
        if bit:
            equal = equal & plane
        else:
            greater = greater | (equal & plane)
            equal = equal & ~plane
    return greater


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest position that each of n positions reaches over the pairs."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def tile_edges(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the tile: every linked value with its component's first one."""
    left, right = close_pairs(values)
    label = roots(len(values), left, right)
    away = np.flatnonzero(label != np.arange(len(values)))
    return values[away], values[label[away]]


def bucket_edges(batches):
    """Links in each partition's rows, sorted by bucket; a bucket is compared in one tile.

    Small buckets share a tile: a link between two of them is a link as well.
    """
    held_bucket, held_value = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)

    def out(value):
        a, b = tile_edges(np.unique(value))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def tiles(bucket, value, last):
        """Tiles of whole buckets, and what is left for the next batch."""
        new = np.flatnonzero((bucket[1:] != bucket[:-1]).any(axis=1)) + 1
        edges = np.r_[0, new, len(value)]
        sizes = np.diff(edges)
        if not last:
            kept_from, sizes = edges[-2], sizes[:-1]
        else:
            kept_from = len(value)
        # A bucket of one fingerprint has no pair.
        paired = np.repeat(sizes > 1, sizes)
        chosen, sizes = value[:kept_from][paired], sizes[sizes > 1]
        ends, begin, found = np.cumsum(sizes), 0, []
        while begin < len(chosen):
            fit = np.searchsorted(ends, begin + TILE // 4, "right")
            until = ends[fit - 1] if fit and ends[fit - 1] > begin else ends[np.searchsorted(ends, begin, "right")]
            found.append(chosen[begin:until])
            begin = until
        return found, kept_from

    for batch in batches:
        bucket = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
        bucket = np.concatenate([held_bucket, bucket])
        value = np.concatenate([held_value, batch.column(2).to_numpy().view(np.uint64)])
        if not len(value):
            continue
        found, kept = tiles(bucket, value, False)
        yield from map(out, found)
        held_bucket, held_value = bucket[kept:], value[kept:]
    if len(held_value):
        yield from map(out, tiles(held_bucket, held_value, True)[0])


def bucket_rows(distinct: DataFrame) -> DataFrame:
    """A row per fingerprint and pair of blocks: `bucket`, a number that holds the pair and both values."""
    shifts = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    block = [
        F.shiftrightunsigned("fingerprint", s).bitwiseAND((1 << w) - 1) for s, w in zip(shifts, BLOCKS)
    ]
    pairs = list(combinations(range(len(BLOCKS)), 2))
    keys = [
        F.lit(k << 32).cast("bigint") + F.shiftleft(block[i], BLOCKS[j]) + block[j]
        for k, (i, j) in enumerate(pairs)
    ]
    return distinct.select("fingerprint", F.explode(F.array(*keys)).alias("bucket"))


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what the links of the distinct fingerprints connect.

    A bucket of more than a tile is cut into chunks by a hash; every two chunks meet in a
    task of their own, so the bucket is compared whole, without one task holding it.
    """
    rows = bucket_rows(distinct)
    large = rows.groupBy("bucket").agg(F.count("*").alias("_rows")).where(F.col("_rows") > TILE)
    large = large.select("bucket", F.ceil(F.col("_rows") / (TILE // 2)).cast("bigint").alias("_chunks"))
    # Few buckets are large: known as a table, it is joined without moving the small ones twice.
    large = stored(large, "large-buckets")
    rows = rows.join(large, "bucket", "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    chunk = F.pmod(F.xxhash64("fingerprint"), F.col("_chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1))
    meet = rows.withColumn("_chunk", chunk).withColumn("_other", other)
    low, high = F.least("_chunk", "_other"), F.greatest("_chunk", "_other")
    keyed = meet.select("bucket", (low * F.col("_chunks") + high).alias("meeting"), "fingerprint")
    # A chunk with itself comes once per other chunk otherwise.
    dealt = keyed.repartition("bucket", "meeting").sortWithinPartitions("bucket", "meeting")
    return dealt.mapInArrow(bucket_edges, EDGE_SCHEMA).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, root): the smallest number that each number in `edges` reaches.

    Every round, larger neighbours are hooked to the smallest neighbour (large star), then
    the smaller ones (small star), until nothing changes; each round is a stored table.
    """
    edges = stored(edges.where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low"))
        low = low.select("a", F.least("a", "low").alias("low"))
        starred = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        starred = starred.where("a <> b").distinct()
        # Now a > b throughout: hook each number's other smaller neighbours, and itself, to the smallest.
        least = starred.groupBy("a").agg(F.min("b").alias("low"))
        hooked = starred.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = stored(hooked.union(least.select("a", F.col("low").alias("b"))).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select("a", F.col("b").alias("root"))
        before = now


def component_roots(prints: DataFrame) -> DataFrame:
    """(fingerprint, root, first_id) for each distinct fingerprint; first_id is its smallest doc_id."""
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    distinct = stored(distinct, "distinct-fingerprints")
    rooted = components(links(distinct.select("fingerprint")))
    rooted = rooted.select(F.col("a").alias("fingerprint"), "root")
    named = distinct.join(rooted, "fingerprint", "left")
    return stored(named.withColumn("root", F.coalesce("root", "fingerprint")), "rooted")


def near_groups(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id.

    Null counts as an empty text, whose fingerprint is zero and is linked like any other.
    component_id is the smallest doc_id reachable; null ids do not count in it. Repeated
    rows come out repeated; other columns are not read.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    named = component_roots(prints)
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with one row of each component: the one of the longest text.

    Of equally long ones the smallest doc_id stays, null ids last; of repeated rows, one.
    """
    length = F.length(F.coalesce(F.col("text"), F.lit("")))
    keyed = docs.withColumn("_row_key", row_key(docs)).withColumn("_length", length)
    prints = stored(fingerprints(keyed, "_row_key", "_length"), "fingerprints")
    named = component_roots(prints).select("fingerprint", "root")
    # The best row per fingerprint first, so that a component's copies end before its shuffle.
    best = F.max(F.struct("_length", (-F.col("doc_id")).alias("_id"), "_row_key")).alias("_best")
    firsts = prints.groupBy("fingerprint").agg(best).join(named, "fingerprint")
    stays = firsts.groupBy("root").agg(F.max("_best").alias("_best")).select("_best._row_key")
    return rows_once(docs).join(stays, "_row_key", "left_semi").select("_row.*")
