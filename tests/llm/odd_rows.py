import pytest

LONG = ("longword" * 40 + " and more of it, ") * 400

ROWS = [
    (1, "One small text about a river and the boats on it.\nShared line", "en", "a", 10),
    (1, "One small text about a river and the boats on it.\nShared line", "en", "a", 10),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "no id here, but a text with some words in it", "en", None, 5),
    (4, LONG, "en", "b", len(LONG)),
    (5, "\n\n \t\r\n", "en", "b", 6),
    (6, "Ünïcode ß 日本語     x'll don't 12³ \U0001f642\U0001f642", "de", "b", 30),
    (7, "word", "en", "c", 4),
]
# Names that working columns of some operator have, or might have.
EXTRA = ("text_crc32", "line", "host", "page", "row", "fp", "mask", "key", "shard", "lane", "n",
         "ids", "offsets", "n_tokens", "fail_bits", "leaks", "row_id", "fingerprint_bits")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing extra columns."""
    schema = ("doc_id long, text string, lang string, source string, n_chars long, "
              + ", ".join(f"{c} string" for c in EXTRA))
    return spark.createDataFrame([r + tuple("x" for _ in EXTRA) for r in ROWS], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
