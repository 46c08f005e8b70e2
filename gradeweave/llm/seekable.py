"""Texts as seekable compressed frames, and the fill-in-middle form of a text made from them.

A text is stored as independent zstandard frames of bounded size, with the units, code points
and bytes that end by the end of each frame. A cut after so many units is found in these
counts, and only its frame is decompressed; all other frames go into the output as they are.
The output is a row of frames itself, in order, so it is one zstandard stream; digests read it
frame by frame.

A unit is a word with the blanks before it, or the blanks that end a text.
"""

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FRAME_BYTES = 1 << 16
LEVEL = 3
#: Fixed values of the contract: marks of prefix, suffix and middle, and the shares of the forms.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "42"
FORMED_OF_100 = 50
SUFFIX_FIRST_OF_100 = 80
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Rows of an output batch.
BATCH_ROWS = 1024

#: Space and tab to carriage return, by byte; no byte of a longer code point is among them.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

FRAMES = "frames array<binary>, units array<bigint>, chars array<bigint>, bytes array<bigint>"
FORMED = "key {key}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output array<binary>"


def word_ends(raw: np.ndarray, following: int | None) -> np.ndarray:
    """Places after the last byte of each word; `following` is the byte after these, None at the end."""
    blank = BLANK[raw]
    after = np.empty_like(blank)
    after[:-1] = blank[1:]
    after[-1:] = following is None or BLANK[following]
    return np.flatnonzero(~blank & after) + 1


def code_points(raw: np.ndarray) -> int:
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def frames_of(data: bytes, compress, frame_bytes: int = FRAME_BYTES):
    """(frames, units, chars, bytes) of a UTF-8 text: counts as of the end of each frame.

    Frames end between code points. A unit counts where it ends; the blanks that end a text
    are the last unit.
    """
    frames, units, chars, ends = [], [], [], []
    at = n = points = 0
    while at < len(data):
        to = min(at + frame_bytes, len(data))
        while to < len(data) and to > at + 1 and data[to] & 0xC0 == 0x80:
            to -= 1
        raw = np.frombuffer(data, np.uint8, to - at, at)
        n += len(word_ends(raw, data[to] if to < len(data) else None))
        points += code_points(raw)
        if to == len(data) and BLANK[raw[-1]]:
            n += 1
        frames.append(compress(data[at:to]))
        units.append(n)
        chars.append(points)
        ends.append(to)
        at = to
    return frames, units, chars, ends


def as_columns(batch, rows, names):
    """The batch's other columns with new ones made from one tuple per row."""
    made = [pa.array(column, kind) for column, (_, kind) in zip(zip(*rows), names)]
    kept = [name for name in batch.schema.names if name not in ("text", *[n for n, _ in names])]
    return pa.RecordBatch.from_arrays([*map(batch.column, kept), *made], [*kept, *[n for n, _ in names]])


def slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def frame_batches(frame_bytes):
    names = [("frames", pa.list_(pa.binary())), *[(n, pa.list_(pa.int64())) for n in ("units", "chars", "bytes")]]

    def run(batches):
        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in slices(batches):
            texts = batch.column("text").cast(pa.binary())
            yield as_columns(batch, [frames_of(t.as_py() or b"", compress, frame_bytes) for t in texts], names)

    return run


def text_frames(docs: DataFrame, key: str = "doc_id", text: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """(key, n, marked, frames, units, chars, bytes): each document's text as seekable frames.

    `n` is the number of units, `marked` tells whether the text holds one of the three marks.
    Null texts count as empty, which has no frame. A row each: repeated rows, null keys and
    texts of any length are rows like any other, an empty table gives none, other columns are
    not read.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    marked = value.contains(PREFIX) | value.contains(SUFFIX) | value.contains(MIDDLE)
    rows = docs.select(F.col(key).alias("key"), marked.alias("marked"), value.alias("text"))
    kind = dict(rows.dtypes)["key"]
    framed = rows.mapInArrow(frame_batches(frame_bytes), f"key {kind}, marked boolean, {FRAMES}")
    n = F.coalesce(F.try_element_at("units", F.lit(-1)), F.lit(0).cast("bigint"))
    return framed.withColumn("n", n)


class Reader:
    """Frames of one row; the one read last is kept, as cuts and ranges often share it."""

    def __init__(self, frames):
        self.frames, self.last, self.data = frames, -1, b""
        self.decompress = zstandard.ZstdDecompressor().decompress

    def frame(self, i: int) -> bytes:
        if i != self.last:
            self.last, self.data = i, self.decompress(self.frames[i])
        return self.data


def locate(cut: int, units, chars, ends, reader: Reader):
    """(frame, byte in it, code points before) where `cut` units have ended."""
    if cut == 0:
        return 0, 0, 0
    i = int(np.searchsorted(units, cut))
    start, points = (ends[i - 1], chars[i - 1]) if i else (0, 0)
    raw = np.frombuffer(reader.frame(i), np.uint8)
    # Words that end inside the frame; what the count has beyond these ends with it.
    inside = word_ends(raw, raw[-1])
    inside = inside[inside < len(raw)]
    place = cut - (units[i - 1] if i else 0) - 1
    if place >= len(inside):
        return i, ends[i] - start, chars[i]
    return i, int(inside[place]), points + code_points(raw[: inside[place]])


def span(first, last, reader: Reader):
    """The parts from one cut to another: bytes of cut frames, and numbers of whole ones."""
    (i, at, _), (j, to, _) = first, last
    if i == j:
        return [reader.frame(i)[at:to]] if to > at else []
    head = [i] if at == 0 else [reader.frame(i)[at:]]
    tail = [reader.frame(j)[:to]] if to else []
    return [*head, *range(i + 1, j), *tail]


def formed(form, low, high, frames, units, chars, ends, compress):
    """(prefix_chars, middle_chars, output frames); the counts are None for the plain form."""
    if form == PLAIN:
        return None, None, frames
    reader = Reader(frames)
    a, b = (locate(cut, units, chars, ends, reader) for cut in (low, high))
    start, end = (0, 0, 0), (len(frames), 0, chars[-1])
    prefix, middle, suffix = span(start, a, reader), span(a, b, reader), span(b, end, reader)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    order = [s, *suffix, p, *prefix] if form == SPM else [p, *prefix, s, *suffix]
    out, held = [], []
    for part in [*order, m, *middle]:
        if isinstance(part, bytes):
            held.append(part)
            continue
        if held:
            out.append(compress(b"".join(held)))
            held = []
        out.append(frames[part])
    if held:
        out.append(compress(b"".join(held)))
    return a[2], b[2] - a[2], out


def form_batches(batches):
    names = [("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.list_(pa.binary()))]
    inputs = ("form", "low", "high", "frames", "units", "chars", "bytes")
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    for batch in slices(batches):
        columns = zip(*[batch.column(name).to_pylist() for name in inputs])
        kept = batch.select(["key", "n", "form"])
        yield as_columns(kept, [formed(*row, compress) for row in columns], names)


def draw(key: Column, group: int, seed: str = SEED) -> Column:
    """The group-th 8 hex digits of sha256 of seed:key, as a number; a null key counts as ''."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(named, 256), 8 * group - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(frames: DataFrame, seed: str = SEED) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of rows of `text_frames`.

    `output` is the formed text as ordered zstandard frames. Texts that are empty, hold a
    mark, or are not drawn stay plain: output as stored, null counts. Rows with one key, as
    repeated rows, are drawn alike.
    """
    drawn = [draw(F.col("key"), group, seed) for group in (1, 2, 3, 4)]
    plain = (F.col("n") == 0) | F.col("marked") | (drawn[2] % 100 >= FORMED_OF_100)
    form = F.when(plain, PLAIN).when(drawn[3] % 100 < SUFFIX_FIRST_OF_100, SPM).otherwise(PSM)
    cuts = [h % (F.col("n") + 1) for h in drawn[:2]]
    asked = frames.select(
        "key", "n", form.alias("form"), F.least(*cuts).alias("low"), F.greatest(*cuts).alias("high"),
        "frames", "units", "chars", "bytes",
    )
    return asked.mapInArrow(form_batches, FORMED.format(key=dict(frames.dtypes)["key"]))


def stream(reader: Reader, ranges=None, lengths=None):
    """The bytes of all frames in order, or of the given byte ranges, a frame at a time."""
    if ranges is None:
        for i in range(len(reader.frames)):
            yield reader.frame(i)
        return
    ends = np.cumsum(lengths)
    for start, stop in ranges:
        i = int(np.searchsorted(ends, start, "right"))
        while start < stop:
            first = int(ends[i]) - lengths[i]
            yield reader.frame(i)[start - first : stop - first]
            start, i = int(ends[i]), i + 1


def marks_at(reader: Reader):
    """({mark: byte place}, frame lengths): where each mark stands first, also across frames."""
    places, lengths, at, tail = {}, [], 0, b""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    for data in stream(reader):
        seen = tail + data
        for mark in marks:
            if mark not in places and (found := seen.find(mark)) >= 0:
                places[mark] = at - len(tail) + found
        lengths.append(len(data))
        at += len(data)
        tail = seen[-2:]
    return places, lengths


def restored(output, form):
    """The text's bytes, a frame at a time, from an output and its form alone."""
    reader = Reader(output)
    if form == PLAIN:
        yield from stream(reader)
        return
    places, lengths = marks_at(reader)
    p, s, m = (places[x.encode()] for x in (PREFIX, SUFFIX, MIDDLE))
    prefix = (p + 3, m if form == SPM else s)
    suffix = (s + 3, p if form == SPM else m)
    yield from stream(reader, [prefix, (m + 3, sum(lengths)), suffix], lengths)


def sha256_of(pieces) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def digest_batches(batches):
    names = [("output_sha256", pa.string()), ("restored_sha256", pa.string())]
    for batch in slices(batches):
        rows = [
            (sha256_of(stream(Reader(output))), sha256_of(restored(output, form)))
            for output, form in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())
        ]
        yield as_columns(batch.drop_columns(["output"]), rows, names)


def with_digests(formed_rows: DataFrame) -> DataFrame:
    """Instead of `output`, sha256 of the output and of the text rebuilt from output and form."""
    kinds = ", ".join(f"{name} {kind}" for name, kind in formed_rows.dtypes if name != "output")
    return formed_rows.mapInArrow(digest_batches, f"{kinds}, output_sha256 string, restored_sha256 string")


def text_batches(batches):
    for batch in slices(batches):
        rows = [
            (b"".join(stream(Reader(output))).decode(), b"".join(restored(output, form)).decode())
            for output, form in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist())
        ]
        yield as_columns(batch.drop_columns(["output"]), rows, [("output_text", pa.string()), ("restored_text", pa.string())])


def with_texts(formed_rows: DataFrame) -> DataFrame:
    """Instead of `output`, the formed text and the rebuilt one as strings."""
    kinds = ", ".join(f"{name} {kind}" for name, kind in formed_rows.dtypes if name != "output")
    return formed_rows.mapInArrow(text_batches, f"{kinds}, output_text string, restored_text string")


def fim_report(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n, form, prefix_chars, middle_chars and both digests.

    The frames are a stored table, as a corpus would keep them; see `text_frames` and
    `fill_in_middle` for nulls, empty and long texts and repeated rows.
    """
    frames = stored(text_frames(docs), "text-frames")
    return with_digests(fill_in_middle(frames)).withColumnRenamed("key", "doc_id")
