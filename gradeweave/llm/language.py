"""Language identification by word-first backoff.

A known word counts with its log frequency in each language; an unseen one with that of its
longest known character n-grams, from four letters down to one.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, by_bytes, coded, stored, words_of

UNKNOWN = "und"
#: The fit's bound: expected training documents per language. All their words and n-grams are kept.
SAMPLE_PER_LANGUAGE = 2000
#: Unseen words whose scores a task remembers.
REMEMBERED = 50_000
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
NOT_LETTERS = r"[^\p{L}\p{M}]+"
LETTER = r"\p{L}"
#: Characters of ASCII that are no letters; at one of them a text may be cut between words.
CUT = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def letter_words(texts: pa.Array):
    """(words, counts) of the texts: lower-case runs of letters."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    return words_of(pc.replace_substring_regex(pc.utf8_lower(texts), NOT_LETTERS, " "), lower=False)


def count_words(batches):
    """(lang, word, n) of each batch."""
    for batch in by_bytes(batches):
        for part in text_parts(batch.column("text")):
            words, counts = letter_words(part)
            lang = batch.column("lang").take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            table = pa.table({"lang": lang, "word": words.cast(pa.string())})
            table = table.group_by(["lang", "word"]).aggregate([([], "count_all")])
            yield from table.rename_columns(["lang", "word", "n"]).to_batches()


class Model:
    """Log frequencies: `words` and, by order, `grams`, each (items, a row of scores per item).

    Items are an Arrow array; only a task's process makes Python strings of them.
    """

    def __init__(self, langs, words, grams):
        self.langs, self.words, self.grams = langs, words, grams

    def ready(self):
        """Makes the lookups, once in each task's process."""
        if not hasattr(self, "places"):
            place = lambda items: {name: i for i, name in enumerate(names_of(items))}
            self.vocabulary = place(self.words[0])
            self.places = {order: place(items) for order, (items, _) in self.grams.items()}
            self.remembered = {}
        return self

    def unseen(self, word: str) -> np.ndarray:
        self.ready()
        if word in self.remembered:
            return self.remembered[word]
        marked, value = f"^{word}$", np.zeros(len(self.langs), np.float32)
        for order in ORDERS:
            known = self.places[order]
            at = [known[g] for i in range(len(marked) - order + 1) if (g := marked[i : i + order]) in known]
            if at:
                value = self.grams[order][1][at].mean(axis=0)
                break
        if len(self.remembered) >= REMEMBERED:
            self.remembered.clear()
        self.remembered[word] = value
        return value

    def of_words(self, distinct: pa.Array) -> np.ndarray:
        """A row of scores for each of some distinct words."""
        _, scores = self.words
        names, place = distinct.to_pylist(), self.vocabulary.get
        at = np.fromiter((place(name, -1) for name in names), np.int64, len(names))
        value = scores[np.maximum(at, 0)] if len(scores) else np.zeros((len(at), len(self.langs)), np.float32)
        for i in np.flatnonzero(at < 0).tolist():
            value[i] = self.unseen(names[i])
        return value


def scores_of(counts: DataFrame, langs):
    """(items, scores): log P(lang | item) of each item if languages were equally common.

    `counts` has item, lang and n; a row per item comes to the driver, as plain columns.
    """
    of_lang = [F.sum(F.when(F.col("lang") == g, F.col("n")).otherwise(0)).alias(f"n{i}") for i, g in enumerate(langs)]
    found = counts.groupBy("item").agg(*of_lang).toArrow()
    logs = np.stack([found.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1).astype(np.float64)
    total = logs.sum(axis=0)
    logs = np.log(logs + SMOOTHING) - np.log(total + SMOOTHING * max(1, len(logs)))
    logs -= np.logaddexp.reduce(logs, axis=1, keepdims=True)
    return found.column("item").combine_chunks(), logs.astype(np.float32)


def names_of(items) -> list:
    return items.to_pylist() if isinstance(items, (pa.Array, pa.ChunkedArray)) else list(items)


def fit(training: DataFrame, sample=SAMPLE_PER_LANGUAGE, seed=7) -> Model:
    """A model from rows of doc_id, text and lang (non-null), with about `sample` rows a language.

    A row is drawn by a hash of its id, so the layout of files does not matter; rows that
    agree in all three count once. Words and n-grams are counted by Spark; the driver gets the
    counts of the drawn rows, which is all that bounds the model.
    """
    sizes = {r["lang"]: r["count"] for r in training.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], ([], np.zeros((0, 0), np.float32)), {n: ([], np.zeros((0, 0), np.float32)) for n in ORDERS})
    shares = F.create_map(*[F.lit(v) for g in langs for v in (g, min(1.0, sample / sizes[g]))])
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 32)) / float(1 << 32)
    drawn = training.where(draw < F.try_element_at(shares, F.col("lang"))).dropDuplicates(["doc_id", "lang", "text"])
    counted = drawn.select("lang", "text").mapInArrow(count_words, "lang string, word string, n bigint")
    counted = stored(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")

    words = scores_of(counted.select("lang", F.col("word").alias("item"), "n"), langs)
    marked = counted.select("lang", "n", F.concat(F.lit("^"), "word", F.lit("$")).alias("m"))
    grams = {}
    for order in ORDERS:
        cut = F.expr(f"transform(sequence(1, length(m) - {order - 1}), i -> substring(m, i, {order}))")
        cut = F.when(F.length("m") >= order, cut)
        rows = marked.select("lang", "n", F.explode(cut).alias("item"))
        grams[order] = scores_of(rows, langs)
    return Model(langs, words, grams)


def pieces(text: bytes):
    """The text in parts of about SLICE_BYTES, none cut inside a word."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = CUT.search(text, at + SLICE_BYTES)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


def text_parts(texts: pa.Array):
    """The texts of a slice together, or one that is longer than a slice in parts."""
    if len(texts) == 1 and texts[0].is_valid and len(data := texts[0].as_buffer()) > SLICE_BYTES:
        for piece in pieces(data.to_pybytes()):
            yield pa.array([piece], pa.binary()).cast(pa.string())
    else:
        yield texts


def add_scores(model: Model, texts: pa.Array, sums: np.ndarray):
    """Adds the scores of the words of each text to its row of `sums`; a word counts as often as it comes."""
    words, counts = letter_words(texts)
    if not len(words):
        return
    codes, distinct = coded(words)
    owner = np.repeat(np.arange(len(counts)), counts)
    pairs, times = np.unique(owner * len(distinct) + codes, return_counts=True)
    owner, code = np.divmod(pairs, len(distinct))
    value = model.of_words(distinct)
    for lang in range(len(model.langs)):
        sums[:, lang] += np.bincount(owner, value[code, lang] * times, len(counts))


def predictor(broadcast):
    """A mapInArrow function: (row columns..., text) to the same with lang_pred and score."""

    def run(batches):
        model = broadcast.value.ready()
        langs = model.langs
        for batch in by_bytes(batches):
            texts = batch.column("text")
            sums = np.zeros((len(texts), len(langs)))
            letter = np.zeros(len(texts), bool)
            for part in text_parts(texts):
                has = pc.fill_null(pc.match_substring_regex(part, LETTER), False)
                letter |= has.to_numpy(zero_copy_only=False)
                if langs:
                    add_scores(model, part, sums)
            named, certain = [], []
            for row, has in zip(sums, letter.tolist()):
                if not has or not langs:
                    named.append(UNKNOWN)
                    certain.append(0.0)
                    continue
                best = int(row.argmax())  # of equals the first by code point
                named.append(langs[best])
                certain.append(float(1.0 / np.exp(np.maximum(row - row[best], -700.0)).sum()))
            kept = [name for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, kept), pa.array(named, pa.string()), pa.array(certain, pa.float64())],
                [*kept, "lang_pred", "score"],
            )

    return run


def held_out(doc_id, modulus: int, remainder: int):
    """Whether a document is kept out of training; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """A row per document: doc_id, lang_pred and score. Only the text is looked at."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(predictor(shared), f"doc_id {kind}, lang_pred string, score double")


def train_and_predict(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, lang_pred, score.

    Learns from documents with text and lang whose id is not held out. `und`, with score 0,
    for null texts, texts without a letter, and if there is nothing to learn from. Words that
    no language knows weigh nothing; of equal languages the first by code point is taken.
    """
    model = fit_documents(docs)
    return predictions(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score"
    )


def fit_documents(docs: DataFrame) -> Model:
    usable = F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 3, 1)
    return fit(docs.where(usable).select("doc_id", "text", "lang"))


def with_language(docs: DataFrame) -> DataFrame:
    """The documents, all columns, whose text has a language; those of `und` go."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_documents(docs))
    return docs.mapInArrow(keeper(shared), docs.schema)


def keeper(broadcast):
    """A mapInArrow function that keeps the rows whose language is known."""
    predict = predictor(broadcast)

    def run(batches):
        for batch in by_bytes(batches):
            text = pa.RecordBatch.from_arrays([batch.column("text")], ["text"])
            (labelled,) = predict([text])
            yield batch.filter(pc.not_equal(labelled.column("lang_pred"), UNKNOWN))

    return run
