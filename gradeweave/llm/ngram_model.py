"""N-gram scoring with an Elias-Fano trie.

Texts become blocks of word codes, stored once. Level by level, each block sends its distinct
n-grams with their training counts to shards, as contexts and lists of their successors. A
context goes whole to the shard of its hash, so that its shard knows its count. Only contexts
of more than a quarter of a shard's mean share, which the level below names (at most four per
shard), are split by successor, and their counts sent along. A shard merges its lists into its
part of the level and answers every block by successor search in it. The answers go back to
the blocks, which score their documents. The model is the table of shard levels; it grows with
the corpus, as the number of shards does, and is never in one place.

The first level gives exact counts. Higher levels hold quantised probabilities, discounted by
a Dirichlet prior, and for each context the quantised weight of the shorter context:

    P(w | context) = c(context w) / (c(context) + MASS) + MASS / (c(context) + MASS) * P(w | shorter context)
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import coded, hashes, mixed, parts_of, words_of
from .elias_fano import SUCCESSOR_BITS, SUCCESSOR_MASK, Level, Lists, Sequence, Words, encode, unquantised

ORDER = 2
MASS = 8.0
BLOCK_TOKENS = 2_000_000
#: Tokens a shard of a level is made for; the session's shuffle partitions are the least number of shards.
SHARD_TOKENS = 16_000_000
#: Hashes of the marks before and after each text; no word's hash is mixed to these but by chance.
BEGIN, END = np.uint64(1), np.uint64(2)
PAIR = np.uint64(0x9E3779B97F4A7C15)
BLOCK_SCHEMA = (
    "block bigint, tokens bigint, train_tokens bigint, train_texts bigint, "
    "ids array<bigint>, train binary, counts binary, words binary, codes binary"
)
RUN_SCHEMA = "shard int, block bigint, keys binary, counts binary"
SHARD_SCHEMA = "kind string, shard int, block bigint, data binary, weights binary, types bigint"
LEVEL_SCHEMA = f"level int, {SHARD_SCHEMA}"
SCORE_SCHEMA = "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def block_batches(most):
    """Documents (doc_id, train, text) to blocks of at most `most` words, or one document."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            words, counts = words_of(batch.column("text"))
            ends = np.cumsum(counts)
            first = 0
            while first < len(counts):
                done = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, done + most, "right")))
                codes, distinct = coded(words.slice(done, ends[last - 1] - done))
                train = batch.column("train").slice(first, last - first).to_numpy(zero_copy_only=False).astype(np.uint8)
                sizes = counts[first:last].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block]),
                        pa.array([int(sizes.sum()) + len(sizes)]),
                        pa.array([int(((sizes + 1) * train).sum())]),
                        pa.array([int(train.sum())]),
                        pa.array([batch.column("doc_id").slice(first, last - first).to_pylist()], pa.list_(pa.int64())),
                        pa.array([train.tobytes()]),
                        pa.array([sizes.tobytes()]),
                        pa.array([mixed(hashes(distinct)).tobytes()]),
                        pa.array([codes.astype(np.int32).tobytes()]),
                    ],
                    ["block", "tokens", "train_tokens", "train_texts", "ids", "train", "counts", "words", "codes"],
                )
                block += 1
                first = last

    return run


def gram_hashes(contexts: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Hashes of n-grams as contexts of the next level."""
    with np.errstate(over="ignore"):
        return mixed(contexts * PAIR + successors)


class Grams:
    """A block's n-grams on one level: per token the number of its n-gram, per n-gram its hash.

    On the levels above the words, `context` is the number of each n-gram's context, whose hash
    is in `context_hashes`, and `successor` its number in the context's list.
    """

    def __init__(self, row):
        counts = np.frombuffer(row["counts"], np.int64)
        codes = np.frombuffer(row["codes"], np.int32)
        self.words = np.r_[np.frombuffer(row["words"], np.uint64), END]
        ends = np.cumsum(counts + 1) - 1
        self.own = np.full(len(codes) + len(counts), len(self.words) - 1)
        inner = np.ones(len(self.own), bool)
        inner[ends] = False
        self.own[inner] = codes
        self.first = np.zeros(len(self.own), bool)
        self.first[ends - counts] = True
        self.train = np.repeat(np.frombuffer(row["train"], np.uint8).astype(bool), counts + 1)
        self.ids, self.hashes = self.own, self.words

    def climb(self):
        """Goes to the next level, where the n-grams so far are the contexts of the words after them."""
        begin, width = len(self.hashes), len(self.words)
        self.context_hashes = np.r_[self.hashes, BEGIN]
        before = np.r_[begin, self.ids[:-1]]
        before[self.first] = begin
        pairs, self.ids = np.unique(before * width + self.own, return_inverse=True)
        self.context = pairs // width
        hashed = self.context_hashes[self.context]
        with np.errstate(over="ignore"):
            self.successor = mixed(hashed * PAIR ^ self.words[pairs % width]) & SUCCESSOR_MASK
        self.hashes = gram_hashes(hashed, self.successor)

    def train_counts(self):
        return np.bincount(self.ids[self.train], minlength=len(self.hashes))

    def dealt(self, shards):
        """(n-grams in order of shard and hash, where each shard begins)."""
        return by_shard((mixed(self.hashes) % np.uint64(shards)).astype(np.int64), np.argsort(self.hashes), shards)

    def dealt_lists(self, shards, hot):
        """(n-grams in order of shard, context and successor, where each shard begins, where each list does)."""
        order = np.argsort(self.context_hashes)
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        rank = rank[self.context]
        shard = (mixed(self.context_hashes) % np.uint64(shards)).astype(np.int64)[self.context]
        split = np.isin(self.context_hashes, hot)[self.context]
        shard[split] = (mixed(self.hashes[split]) % np.uint64(shards)).astype(np.int64)
        place, borders = by_shard(shard, np.argsort((rank << np.uint64(SUCCESSOR_BITS)) | self.successor), shards)
        new = np.ones(len(place), bool)
        new[1:] = (rank[place[1:]] != rank[place[:-1]]) | (shard[place[1:]] != shard[place[:-1]])
        return place, borders, np.flatnonzero(new)


def by_shard(shard, order, shards):
    kind = np.uint16 if shards < 1 << 16 else np.int64  # short numbers are sorted by their digits
    place = order[np.argsort(shard[order].astype(kind), kind="stable")]
    return place, np.searchsorted(shard[place], np.arange(shards + 1))


def planes(values: np.ndarray, size: int) -> bytes:
    """Numbers by byte planes, which Spark's compression shrinks where the upper ones are zero."""
    return values.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def unplanes(data: bytes, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(f"<u{size}").ravel()


def rows_of(batch):
    """A batch's rows as dicts whose binary values are views."""
    for i in range(batch.num_rows):
        yield {
            name: (value.as_buffer() if pa.types.is_binary(value.type) or pa.types.is_large_binary(value.type) else value.as_py())
            for name, value in ((n, batch.column(n)[i]) for n in batch.schema.names)
        }


def run_batches(level, shards, hot):
    """Blocks to runs: for each shard, the block's distinct n-grams there and their training counts."""

    def run(batches):
        for batch in batches:
            for row in rows_of(batch):
                grams = Grams(row)
                for _ in range(level - 1):
                    grams.climb()
                if level == 1:
                    place, borders = grams.dealt(shards)
                else:
                    place, borders, heads = grams.dealt_lists(shards, hot)
                    owner = np.cumsum(np.bincount(heads, minlength=len(place))) - 1
                    contexts = grams.context_hashes[grams.context[place[heads]]]
                    sent = grams.successor[place]
                counts = grams.train_counts()[place]
                used = np.flatnonzero(np.diff(borders))
                ranges = [(borders[s], borders[s + 1]) for s in used]
                keys = []
                for a, b in ranges:
                    if level == 1:
                        keys.append(encode(grams.hashes[place[a:b]], 64).tobytes())
                    else:
                        first, last = owner[a], owner[b - 1] + 1
                        keys.append(Lists.build(contexts[first:last], owner[a:b] - first, sent[a:b]).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int32)),
                        pa.array(np.full(len(used), row["block"])),
                        pa.array(keys, pa.binary()),
                        pa.array([planes(counts[a:b], 8) for a, b in ranges], pa.binary()),
                    ],
                    ["shard", "block", "keys", "counts"],
                )

    return run


def merged(keys, counts):
    """Sorted distinct keys with the sums of their counts, those above 0."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    keys, counts = keys[new], np.add.reduceat(counts, new)
    return keys[counts > 0], counts[counts > 0]


def shard_maker(level, hot, hot_counts, most, mass):
    """A function of one shard's runs: its part of the level, an answer to every run, its hot n-grams."""

    def words(runs, counts):
        runs = [Sequence(run).decode() for run in runs]
        keys, counts = merged(np.concatenate(runs), counts)
        data = Words.build(keys, counts)
        part = Words(data)
        return data, keys, counts, [(planes(part.counts_of(run), 8), None) for run in runs]

    def lists(runs, counts):
        runs = [Lists(run).decode() for run in runs]
        contexts = np.unique(np.concatenate([c for c, _, _ in runs]))
        keys = [
            (np.searchsorted(contexts, c)[rank].astype(np.uint64) << np.uint64(SUCCESSOR_BITS)) | successors
            for c, rank, successors in runs
        ]
        keys, counts = merged(np.concatenate(keys), counts)
        rank, successors = (keys >> np.uint64(SUCCESSOR_BITS)).astype(np.int64), keys & SUCCESSOR_MASK
        # A whole context was counted as often as its successors; of a split one all is known.
        total = np.bincount(rank, counts, len(contexts))
        split, at, known = np.intersect1d(contexts, hot, return_indices=True)
        total[at] = hot_counts[known]
        kept = total > 0
        data = Level.build(
            contexts[kept], (np.cumsum(kept) - 1)[rank], successors, counts / (total[rank] + mass), mass / (total[kept] + mass)
        )
        part = Level(data)
        answers = [tuple(planes(x, 2) for x in part.answer(*run)) for run in runs]
        return data, gram_hashes(contexts[rank], successors), counts, answers

    def make(table: pa.Table) -> pa.Table:
        runs = [np.frombuffer(k.as_buffer(), np.uint64) for k in table["keys"]]
        counts = np.concatenate([unplanes(c.as_buffer(), 8) for c in table["counts"]]).astype(np.int64)
        data, grams, counts, answers = (words if level == 1 else lists)(runs, counts)
        rows = [("trie", None, data.tobytes(), None, len(grams))]
        rows += [("answer", block, *answer, None) for block, answer in zip(table["block"].to_pylist(), answers)]
        often = counts > most
        if often.any():
            rows.append(("hot", None, grams[often].tobytes(), counts[often].tobytes(), None))
        kinds, blocks, values, weights, types = zip(*rows)
        return pa.table(
            {
                "kind": pa.array(kinds),
                "shard": pa.array([table["shard"][0].as_py()] * len(rows), pa.int32()),
                "block": pa.array(blocks, pa.int64()),
                "data": pa.array(values, pa.binary()),
                "weights": pa.array(weights, pa.binary()),
                "types": pa.array(types, pa.int64()),
            }
        )

    return make


def scorer(order, shards, hot_by_level, tokens, types):
    """A function of a block and its answers: a row per document."""

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        row = next(rows_of(block.combine_chunks().to_batches()[0]))
        by_level = {}
        for level, shard, data, weights in zip(*(answers[c] for c in ("level", "shard", "data", "weights"))):
            by_level.setdefault(level.as_py(), []).append((shard.as_py(), data, weights))

        def joined(level, column, size, n):
            parts = [unplanes(a[column].as_buffer(), size) for a in sorted(by_level[level], key=lambda a: a[0])]
            if sum(map(len, parts)) != n:
                raise RuntimeError("a block's answers do not fit its n-grams")
            return np.concatenate(parts)

        grams = Grams(row)
        counts = np.frombuffer(row["counts"], np.int64) + 1
        starts = np.cumsum(counts) - counts
        position = np.arange(len(grams.own)) - np.repeat(starts, counts)
        known = np.zeros(len(grams.words), np.int64)
        place, _ = grams.dealt(shards)
        known[place] = joined(1, 1, 8, len(place))
        own = known[grams.own]
        chance = (own + 1.0) / (tokens + types + 1.0)
        base = np.log10(chance)
        for level in range(2, order + 1):
            grams.climb()
            place, _, heads = grams.dealt_lists(shards, hot_by_level[level])
            codes = np.zeros(len(place), np.uint16)
            codes[place] = joined(level, 1, 2, len(place))
            weights = np.zeros(len(grams.context_hashes), np.uint16)
            np.maximum.at(weights, grams.context[place[heads]], joined(level, 2, 2, len(heads)))
            rest = unquantised(weights, 1.0)[grams.context]
            smoothed = np.minimum(1.0, unquantised(codes, 0.0)[grams.ids] + rest[grams.ids] * chance)
            # The first words of a text have fewer words before them.
            chance = np.where(position >= level - 2, smoothed, chance)
        total = lambda x: np.add.reduceat(x, starts)
        return pa.table(
            {
                "doc_id": pa.array(row["ids"], pa.int64()),
                "n_tokens": pa.array(counts),
                "n_known": pa.array(total((own > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(counts), tokens, np.int64)),
                "base_score": pa.array(total(base)),
                "score": pa.array(total(np.log10(chance))),
            }
        )

    return score


def hot_contexts(below: DataFrame | None, texts: int, most: int):
    """(hashes, counts) of the contexts counted more than `most` times, from the level below.

    Tokens are counted once each on a level, so there are at most tokens / most of them.
    """
    rows = below.where("kind = 'hot'").select("data", "weights").collect() if below is not None else []
    hot = np.concatenate([np.frombuffer(r["data"], np.uint64) for r in rows] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(r["weights"], np.int64) for r in rows] or [np.zeros(0, np.int64)])
    if below is not None and texts > most:
        hot, counts = np.r_[hot, BEGIN], np.r_[counts, texts]
    return hot, counts


def train_and_score(docs: DataFrame, train, path: str | None = None, order=ORDER, mass=MASS) -> DataFrame:
    """A row per document, with the columns of SCORE_SCHEMA; `train` is true for documents learnt from.

    Null counts as an empty text, which is its end mark alone; tokens are the words and the
    end. base_score is the add-one unigram score. The trie's parts are written below `path`
    (levels/level=1/kind=trie and so on), a folder of the shared one by default. Repeated rows
    count and come out each; other columns are not read; with nothing to learn from, all words
    are unseen.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "ngram-model")
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), train.alias("train"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows.mapInArrow(block_batches(BLOCK_TOKENS), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(f"{path}/blocks")
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    size, tokens, texts = (x or 0 for x in blocks.agg(F.sum("tokens"), F.sum("train_tokens"), F.sum("train_texts")).first())
    shards = max(parts_of(spark), -(-size // SHARD_TOKENS))
    most = tokens // (4 * shards)
    below, hot_by_level = None, {}
    for level in range(1, order + 1):
        hot, hot_counts = hot_contexts(below, texts, most)
        hot_by_level[level] = hot
        runs = blocks.mapInArrow(run_batches(level, shards, hot), RUN_SCHEMA)
        made = runs.groupBy("shard").applyInArrow(shard_maker(level, hot, hot_counts, most, mass), SHARD_SCHEMA)
        made.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/levels/level={level}")
        below = spark.read.schema(LEVEL_SCHEMA).parquet(f"{path}/levels").where(F.col("level") == level)
        if level == 1:
            types = below.where("kind = 'trie'").agg(F.sum("types")).first()[0] or 0
    score = scorer(order, shards, hot_by_level, tokens, types)
    answers = spark.read.schema(LEVEL_SCHEMA).parquet(f"{path}/levels").where("kind = 'answer'")
    answers = answers.select("block", "level", "shard", "data", "weights")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORE_SCHEMA)
