import pytest

#: Names that operators use inside; a table may have them as well.
EXTRA = "size long, copies long, position long, shard int, fingerprint string, score double, rows long, hash long, id long, kind string, block long, level int, _row_key long, _copy long, text_key long, old string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    """Pseudo-random words; another seed, another text."""
    out = []
    for i in range(n):
        seed = (seed * 6364136223846793005 + 1442695040888963407 + i) % 2**64
        out.append(WORDS[(seed >> 33) % len(WORDS)])
    return " ".join(out)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows and copies."""
    texts = [None, "", " \t\n", "!!! 123", "A.", prose(1, 40), prose(1, 40).upper(), " " + prose(1, 40) + "\n"]
    texts += [prose(2, 30_000), prose(3, 60), prose(3, 60), prose(4, 3), "é ñ ü " + prose(5, 20), "ſecret K\x1cx"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "é")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0], (None, prose(6, 50), None, None, None), (None, None, None, None, None)]
    rows += [(7, prose(7, 12), "en", "é", 5), (7, prose(8, 12), "en", "é", 5)]
    rows += [(100 + i, prose(9, 25), "en", "a", 0) for i in range(300)]
    return [(*r, *([None] * 16)) for r in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
