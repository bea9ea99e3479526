"""Phrase collocations against brute force and, on a larger table, their SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from conftest import MEDIUM, SMALL
from odd_rows import none, odd  # noqa: F401

from tidemark.llm import collocations as co


def lower(text):
    return text.encode().lower().decode()


def counted(rows):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, " ".join(words[i:i + size])] += 1
    return f, n


def plain(rows, least=10, top=2000):
    f, n = counted(rows)
    often = {k: v for k, v in f.items() if v >= least and " " in k[1]}
    longer = defaultdict(int)
    for (lang, phrase), a in often.items():
        w = phrase.split(" ")
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                longer[lang, " ".join(part)] = max(longer[lang, " ".join(part)], a)
    out = defaultdict(list)
    for (lang, phrase), a in often.items():
        w = phrase.split(" ")
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((10 ** 6 * a * a // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        if not (len(w) == 2 and (lang, phrase) in longer and 100 * longer[lang, phrase] >= 50 * a):
            out[lang].append((-score, -a, phrase.encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s)
                  for lang, found in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def rows_of(df):
    return sorted(tuple(r) for r in df.select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def texts(r, n):
    words = ["Ab", "c", "dé", "E", "f'g", "h", "\U0001f642", "zz", "ÄB"]
    return [(r.choice(["en", "de", None, "und"]),
             "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\r\n"])
                     for _ in range(r.randint(0, 60)))) for _ in range(n)]


@pytest.mark.parametrize("period,held", [(2, 50), (16, 10 ** 6), (10 ** 6, 10 ** 6)])
def test_random_texts(spark, monkeypatch, period, held):
    monkeypatch.setattr(co, "PERIOD", period)
    monkeypatch.setattr(co, "HELD_PHRASES", held)
    monkeypatch.setattr(co, "HELD_CHUNKS", held)
    monkeypatch.setattr(co, "HELD_WORDS", held if held < 100 else 1 << 20)
    rows = texts(random.Random(period), 400)
    df = spark.createDataFrame(rows, "lang string, text string")
    want = plain(rows)
    assert rows_of(co.collocations(df)) == want and len(want) > 100
    assert rows_of(co.collocations(df, top=5)) == plain(rows, top=5)


def test_every_start_is_owned_by_one_chunk():
    r = random.Random(7)
    for _ in range(50):
        tokens = co.tokens_of([t for _, t in texts(r, 20)])
        going, ending = co.parse(tokens)
        n = sum(len(c.split(b" ")) - co.OVERLAP for c in going) + sum(len(c.split(b" ")) for c in ending)
        assert n == sum(t != co.END for t in tokens)


def test_equal_stretches_give_equal_chunks():
    r = random.Random(8)
    shared = [f"w{r.randrange(100)}" for _ in range(400)]
    parsed = []
    for seed in (1, 2):
        before = [f"x{seed}{r.randrange(100)}" for _ in range(50)]
        parsed.append(set(co.parse(co.tokens_of([" ".join(before + shared)]))[0]))
    assert len(parsed[0] & parsed[1]) > 10


def test_large_counts_are_exact(spark):
    a = 3_000_000_000_000
    df = spark.createDataFrame([(a, a + 1, a + 7)], "a long, l long, r long")
    exact = [f"cast({c} AS decimal(16, 0))" for c in "alr"]
    got = df.selectExpr(f"({co.SCALE} * {exact[0]} * {exact[0]}) div ({exact[1]} * {exact[2]}) AS s")
    assert got.first().s == 10 ** 6 * a * a // ((a + 1) * (a + 7))


def test_a_very_long_text(spark, monkeypatch):
    r = random.Random(9)
    text = "".join(t for _, t in texts(r, 3000))
    monkeypatch.setattr(co, "SLICE_BYTES", 1000)
    one = " ".join(f"w{r.randrange(30)}" for _ in range(60_000))     # a single piece
    rows = [("en", text), ("fr", one)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert rows_of(co.collocations(df)) == plain(rows)
    assert "".join(co.parts_of("a.b")) == "a.b" and len(list(co.parts_of(text))) > 10


def test_odd_rows(odd, none):  # noqa: F811
    rows = [(r.lang, r.text) for r in odd.collect()]
    assert rows_of(co.collocations(odd)) == plain(rows)
    assert co.collocations(none).collect() == []


@pytest.mark.parametrize("folder", [SMALL, MEDIUM])
def test_query_against_brute_force_and_sql(spark, folder):
    got = rows_of(co.op12_collocations(spark, folder))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("lang", "text").collect()
    assert got == plain([tuple(d) for d in docs])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert got == sorted(con.execute(co.ORACLE).fetchall())
