"""Context-tree weighting against its definition, evaluated node by node."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from conftest import MEDIUM, SMALL
from odd_rows import none, odd  # noqa: F401
from pyspark.sql import functions as F

from tidemark.llm import context_weighting as cw


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def decisions(text):
    """(byte place's context of DEPTH bytes, prefix, bit) of every binary decision."""
    stream = b"\n" * cw.DEPTH + b" ".join(tokens(text)[:-1]) + b"\n"
    for i in range(cw.DEPTH, len(stream)):
        prefix = 1
        for k in range(7, -1, -1):
            bit = stream[i] >> k & 1
            yield stream[i - cw.DEPTH:i], prefix, bit
            prefix = 2 * prefix + bit


class Model:
    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        longer = defaultdict(set)
        for text in texts:
            for context, prefix, bit in decisions(text):
                for d in range(cw.DEPTH + 1):
                    own = context[cw.DEPTH - d:]
                    self.counts[own, prefix][bit] += 1
                    if d:
                        longer[own[1:], prefix].add(own)
        self.weighted = {}
        for own, prefix in sorted(self.counts, key=lambda k: -len(k[0])):
            zeros, ones = self.counts[own, prefix]
            kt = (math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.log(math.pi)
                  - math.lgamma(zeros + ones + 1))
            if len(own) == cw.DEPTH:
                self.weighted[own, prefix] = kt, 1.0, kt
                continue
            below = sum(self.weighted[c, prefix][0] for c in longer[own, prefix])
            top = max(kt, below)
            total = top + math.log(math.exp(kt - top) + math.exp(below - top)) - math.log(2)
            self.weighted[own, prefix] = total, math.exp(kt - math.log(2) - total), kt
        words = Counter(w for t in texts for w in tokens(t))
        self.words, self.n = words, sum(words.values())

    def one(self, context, prefix):
        mixed, left, last = 0.0, 1.0, 0.5
        for d in range(cw.DEPTH + 1):
            own = context[cw.DEPTH - d:], prefix
            if own not in self.counts:
                break
            zeros, ones = self.counts[own]
            last = (ones + 0.5) / (zeros + ones + 1)
            stop = self.weighted[own][1]
            if d < cw.DEPTH:
                mixed, left, answer = mixed + left * stop * last, left * (1 - stop), mixed + left * last
            else:
                answer = mixed + left * last
        return answer if d or own in self.counts else 0.5

    def score(self, text):
        total = 0.0
        for context, prefix, bit in decisions(text):
            p = self.one(context, prefix)
            total += math.log10(p if bit else 1 - p)
        return total

    def base(self, text):
        size = self.n + len(self.words) + 1
        return sum(math.log10((self.words[t] + 1) / size) for t in tokens(text))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def compare(rows, got):
    model = Model([t for i, t in rows if not held(i)])
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert len(rows) == len(got)
    for (i, text), r in zip(sorted(rows, key=key), sorted(got, key=lambda r: key((r.doc_id, r.text)))):
        own = tokens(text)
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            i, held(i), len(own), sum(model.words[t] > 0 for t in own), model.n)
        assert r.base_score == pytest.approx(model.base(text), rel=1e-12)
        assert r.score == pytest.approx(model.score(text), rel=1e-7, abs=1e-7)


def scored(df):
    return cw.score_texts(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


@pytest.mark.parametrize("block,part", [(16 << 20, 1 << 20), (100, 7)])
def test_random_texts(spark, monkeypatch, block, part):
    monkeypatch.setattr(cw, "BLOCK", block)
    monkeypatch.setattr(cw, "PART", part)
    r = random.Random(5)
    words = ["The", "then", "a", "ü", "\U0001f642x", "\x00", "of", " z", "that"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", "\n", "  ", "\t"])
                        for _ in range(r.randint(0, 40)))) for i in range(150)]
    rows += [(7, None), (None, "null key"), (7, ""), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    compare(rows, scored(df).collect())


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 2.0, 7.25, 1e3 + 0.5, 1e9 + 0.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", cw.log_gamma(F.col("x")).alias("y")).collect():
        assert r.y == pytest.approx(math.lgamma(r.x), rel=1e-12, abs=1e-9)


def test_odd_rows(odd, none):  # noqa: F811
    got = scored(odd).collect()
    compare([(r.doc_id, r.text) for r in odd.collect()], got)
    extra = [c for c in odd.columns if c not in ("n_tokens",)]
    assert all(c in got[0] for c in extra) and got[0].line == "x"
    assert scored(none).collect() == []


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    r = cw.score_texts(df, F.lit(True)).first()
    assert r.train_tokens == r.n_known == 0 and r.base_score == 0
    assert r.score == pytest.approx(3 * 8 * math.log10(0.5)) and r.bits_per_byte == pytest.approx(8)


def test_query_against_the_definition(spark):
    got = cw.op13_context_weighting(spark, SMALL).collect()
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows}
    model = Model([t for i, t in texts.items() if not held(i)])
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert r.base_score == pytest.approx(model.base(texts[r.doc_id]), rel=1e-12)
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-7)


def test_longer_contexts_shorten_held_out_texts(spark, monkeypatch):
    bits = []
    for depth in (1, 3, 6):
        monkeypatch.setattr(cw, "DEPTH", depth)
        got = cw.op13_context_weighting(spark, MEDIUM).where("held_out").agg(
            F.count("*").alias("n"), F.avg("bits_per_byte").alias("bits")).first()
        assert got.n > 100
        bits.append(got.bits)
    assert bits[0] > bits[1] + 0.3 > bits[2] + 0.5 and bits[2] < 2.2
