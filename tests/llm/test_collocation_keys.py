"""phrases are counted as rows of their words' keys, and a key stands for one word."""

import random

import numpy as np
from test_collocations import plain, rows_of, texts

from tidemark.llm import collocations as co

WORDS = [b"a" * n for n in (1, 7, 8, 9, 16, 31, 32, 33, 100)] + [
    b"a\0", b"b", b"\0", b"\0\0", "dé".encode(), b"a" * 31 + b"b", b"a" * 99 + b"b"]


def keys(words, seed):
    text = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
    at = np.append(0, np.flatnonzero(text == co.SPACE) + 1)
    return co.word_keys(text, at, np.full(len(words), seed, np.uint64)).tolist()


def test_keys_depend_on_the_word_and_the_seed_alone():
    first = keys(WORDS, 1)
    assert len(set(first)) == len(WORDS)
    assert keys(WORDS[::-1], 1) == first[::-1]
    assert not set(first) & set(keys(WORDS, 2))
    assert keys([], 1) == []


def test_longer_phrases_are_counted_as_whole_numbers(spark):
    rows = texts(random.Random(3), 200)
    chunks = co.dictionary(spark.createDataFrame(rows, "lang string, text string"))
    words, seed = co.count_words(chunks)
    often = words.where("n >= 10")
    counted = co.count_phrases(chunks, 2, co.bitmap_of(often, 1), seed).where("n >= 10")
    assert dict(counted.dtypes) == {"key0": "bigint", "key1": "bigint", "n": "bigint"}
    spelled = co.spelled(counted, 2, often)
    want = {(lang, p): a for lang, _, p, a, *_ in plain(rows, top=10 ** 6)}
    found = {(r.lang, r.phrase): r.n for r in spelled.collect()}
    pairs = {k: a for k, a in want.items() if k[1].count(" ") == 1}
    assert pairs and pairs.items() <= found.items()


def test_words_of_equal_keys_get_others(spark, monkeypatch):
    # With the first seed a word has the same key in every language.
    monkeypatch.setattr(co, "seed_of", lambda lang, seed, own=co.seed_of: (
        7 if seed == co.SEED else own(lang, seed)))
    rows = texts(random.Random(4), 200)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert co.count_words(co.dictionary(df))[1] == co.SEED + 1
    assert rows_of(co.collocations(df)) == plain(rows)


def test_long_words(spark):
    r = random.Random(5)
    words = [w.decode() for w in WORDS] + ["é" * 40, "x" * 5000]
    rows = [(r.choice(["en", ""]), " ".join(r.choice(words) for _ in range(40))) for _ in range(100)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(co.collocations(df, least=3)) == plain(rows, least=3)
