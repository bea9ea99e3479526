"""Near duplicates by shared runs of words, on planted pairs and against brute force."""

import random

import numpy as np
import pytest
from conftest import SMALL

from tidemark.llm import shared_words, stages
from tidemark.llm.common import worker_store


def plain_set(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(words, r, low, high):
    """The words with so many replaced that the similarity lies in the range."""
    while True:
        out = list(words)
        for place in r.sample(range(len(words)), r.randint(1, len(words) // 15)):
            out[place] = f"new{r.randrange(10 ** 6)}"
        if low <= jaccard(plain_set(" ".join(words)), plain_set(" ".join(out))) < high:
            return out


@pytest.mark.parametrize("bucket_shingles", [4_000_000, 300])
def test_planted_pairs_are_near_duplicates(spark, monkeypatch, bucket_shingles):
    r = random.Random(3)
    rows, pairs = [], 0
    for low in (0.8, 0.82, 0.85, 0.87, 0.9) * 8:
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(150, 400))]
        rows += [(2 * pairs, " ".join(words)),
                 (2 * pairs + 1, " ".join(edited(words, r, low, low + 0.03)))]
        pairs += 1
    far = [f"w{r.randrange(5000)}" for _ in range(300)]
    rows += [(1000, " ".join(far)), (1001, " ".join(edited(far, r, 0.5, 0.7)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = shared_words.near_duplicates
    monkeypatch.setattr(shared_words, "near_duplicates",
                        lambda *a: plain(*a, bucket_shingles=bucket_shingles))
    kept = sorted(x.doc_id for x in stages.near_duplicates(spark, df, SMALL).collect())
    assert kept == [2 * i for i in range(pairs)] + [1000, 1001]


def test_group_of_near_copies_in_parts(spark):
    r = random.Random(4)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(edited(base, r, 0.85, 0.95)) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([" ".join(base), *texts])],
                               "doc_id long, text string")
    assert [x.doc_id for x in stages.near_duplicates(spark, df, SMALL).collect()] == [0]


def test_bucket_links_are_exact():
    r = random.Random(5)
    for _ in range(30):
        base = list(range(r.randint(5, 60)))
        sets = [set(r.sample(base, r.randint(len(base) * 3 // 4, len(base)))) for _ in range(25)]
        roots = [r.randrange(18) for _ in sets]
        got = shared_words.bucket_links(np.array(roots),
                                        [np.array(sorted(s), np.uint64) for s in sets])

        def classes(links):
            name = {x: x for x in roots}
            for a, b in links:
                old, new = name[b], name[a]
                name = {k: new if v == old else v for k, v in name.items()}
            return {frozenset(k for k in name if name[k] == v) for v in name.values()}

        want = [(x, y) for x, a in zip(roots, sets) for y, b in zip(roots, sets)
                if jaccard(a, b) >= 0.8]
        assert classes(got) == classes(want)


def test_stage_against_brute_force(spark):
    from test_groups import plain_fingerprint

    docs = sorted(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), key=lambda d: d.doc_id)
    seen = [(plain_fingerprint(d.text), plain_set(d.text)) for d in docs]
    name = list(range(len(docs)))
    for i, (f, s) in enumerate(seen):
        for j, (g, t) in enumerate(seen[:i]):
            if (f ^ g).bit_count() <= 4 or s and t and jaccard(s, t) >= 0.8:
                low, high = sorted((name[i], name[j]))
                name = [low if x == high else x for x in name]
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = sorted(x.doc_id for x in stages.near_duplicates(spark, df, SMALL).collect())
    assert kept == [d.doc_id for i, d in enumerate(docs) if name[i] == i]


def test_near_duplicates_release_what_other_operators_cached(monkeypatch):
    made = {}
    monkeypatch.setattr(shared_words, "map_texts", lambda *args: made.update(run=args[-1]))
    shared_words.with_bands(None)
    worker_store()["cache"] = list(range(1000))
    made["run"](["a b c d e f"])
    assert not worker_store()
