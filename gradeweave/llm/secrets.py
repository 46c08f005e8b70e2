"""Secret scans: patterns give labelled credentials, inferred grammars find more.

Automata are learnt from the credentials that the patterns find, one per kind, and one from
other strings of the same alphabet. Every other candidate string is scored with all of them;
one that a credential grammar explains much better than the ordinary one is a secret too.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton
from .common import stored

# The kinds in their order, their patterns, and the least lengths.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGN = 12
#: Runs are greedy and maximal, so a least length in the pattern drops just the short ones.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")

#: The fit's bound: distinct examples per kind. A string longer than a piece teaches by its pieces.
SAMPLE = 500
PIECE = 128
#: Bits by which a grammar must beat the ordinary one, in all and per character.
MARGIN_BITS = 8.0
MARGIN_PER_CHARACTER = 0.5
#: A string is of a grammar's format if it takes at most so many times its costliest example's bits a symbol.
FORMAT_SLACK = 1.25
#: Letters a-f, other letters, and digits are the symbols; marks stand for themselves.
SYMBOLS = str.maketrans(
    "0123456789" + "abcdef" + "ghijklmnopqrstuvwxyz" + "ABCDEF" + "GHIJKLMNOPQRSTUVWXYZ",
    "0" * 10 + "a" * 6 + "g" * 20 + "A" * 6 + "G" * 20,
)
SYMBOL_COUNT = 11
SPAN = "kind:int,start:int,end:int,value:string"
SCAN_SCHEMA = f"doc_id bigint, base array<struct<{SPAN}>>, others array<struct<start:int,end:int,value:string>>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, credential) of each pattern's matches, by start and kind."""
    found = []
    lowered = text.lower()
    if any(word in lowered for word in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_ASSIGN:
                found.append((0, *m.span(), m[2]))
    if "AKIA" in text:
        found += [(1, *m.span(), m[0]) for m in ACCESS.finditer(text)]
    found += [(2, *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def other_candidates(text: str, base) -> list[tuple[int, int, str]]:
    """Strings of credential characters, outer marks off, that no base span covers whole."""
    found, at, reach = [], 0, 0
    ordered = sorted((start, end) for _, start, end, _ in base)
    for m in CANDIDATE.finditer(text):
        value = m[0].strip(".-=/+_")
        start = m.start() + m[0].index(value) if value else m.end()
        end = start + len(value)
        while at < len(ordered) and ordered[at][0] <= start:
            reach = max(reach, ordered[at][1])  # the farthest end of spans that begin before it
            at += 1
        if len(value) >= LEAST_ASSIGN and reach < end:
            found.append((start, end, value))
    return found


def scan_batches(batches):
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    other = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    for batch in batches:
        base, others = [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text)
            base.append([dict(zip(("kind", "start", "end", "value"), s)) for s in spans])
            others.append([dict(zip(("start", "end", "value"), s)) for s in other_candidates(text, spans)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(base, span), pa.array(others, other)], ["doc_id", "base", "others"]
        )


def examples(values: DataFrame, sample: int) -> list[str]:
    """A bounded sample of the distinct strings, the same on every run, as symbols.

    Strings longer than PIECE are cut into pieces of that length, each an example; a last
    piece too short to be a credential is none.
    """
    cuts = F.sequence(F.lit(0), F.floor((F.length("value") - 1) / PIECE).cast("int"))
    parts = F.transform(cuts, lambda i: F.substring("value", i * PIECE + 1, F.lit(PIECE)))
    whole = F.when(F.length("value") <= PIECE, F.array("value")).otherwise(
        F.filter(parts, lambda part: F.length(part) >= LEAST_ASSIGN)
    )
    distinct = values.select(F.explode(whole).alias("value")).distinct()
    rows = distinct.orderBy(F.xxhash64("value"), "value").limit(sample).collect()
    return [r["value"].translate(SYMBOLS) for r in rows]


def learn(scanned: DataFrame, sample: int = SAMPLE):
    """(automaton of each kind that has examples, automaton of the other candidates)."""
    base = scanned.select(F.explode("base").alias("s")).select("s.kind", "s.value")
    kinds = []
    for kind in range(3):
        strings = examples(base.where(F.col("kind") == kind).select("value"), sample)
        if strings:
            kinds.append(Automaton(strings, SYMBOL_COUNT))
    rest = examples(scanned.select(F.explode("others.value").alias("value")), 2 * sample)
    return kinds, Automaton(rest, SYMBOL_COUNT)


def is_secret(value: str, kinds, ordinary) -> bool:
    """Whether a credential grammar whose format the string has beats the ordinary one by the margins."""
    string = value.translate(SYMBOLS)
    likely = [kind.bits(string) for kind in kinds if kind.rate(string) <= FORMAT_SLACK * kind.costliest]
    if not likely:
        return False
    gain = ordinary.bits(string) - min(likely)
    return gain >= MARGIN_BITS and gain >= MARGIN_PER_CHARACTER * len(string)


def report_batches(shared):
    def run(batches):
        kinds, ordinary = shared.value
        known = {}
        for batch in batches:
            out = {name: [] for name in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format")}
            for base, others in zip(batch.column("base").to_pylist(), batch.column("others").to_pylist()):
                spans = [(s["start"], s["kind"], s["end"]) for s in base]
                text = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                more = []
                for s in others:
                    value = s["value"]
                    if value not in known:
                        if len(known) > 200_000:
                            known.clear()
                        known[value] = is_secret(value, kinds, ordinary)
                    if known[value]:
                        more.append((s["start"], 3, s["end"]))
                for i, name in enumerate(("n_assign", "n_access", "n_hex")):
                    out[name].append(sum(k == i for _, k, _ in spans))
                out["base_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
                out["spans"].append(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans + more)))
                out["n_format"].append(len(more))
            arrays = [pa.array(v, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, v in out.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *out])

    return run


def find_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """A row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format.

    Null counts as an empty text, which has no span. Spans are code points, end exclusive; an
    assignment's span is the whole match. `format` spans are those the grammars add; each is a
    whole candidate, which no base span covers but which may hold one. Without any credential in the table nothing is added. Repeated rows
    come out repeated; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scanned = stored(rows.mapInArrow(scan_batches, SCAN_SCHEMA), "candidates")
    shared = docs.sparkSession.sparkContext.broadcast(learn(scanned, sample))
    schema = (
        "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_format bigint"
    )
    return scanned.mapInArrow(report_batches(shared), schema)
