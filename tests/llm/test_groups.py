"""Operators 2 and 9 against their laws and brute force."""

import collections
import re

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from odd_rows import none, odd  # noqa: F401
from pyspark.sql import functions as F

from tidemark.llm import components, sharding, simhash


# --- SimHash ------------------------------------------------------------------------------------

def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(values, radius=4):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_masks_cover_every_small_difference():
    import itertools

    for radius in (1, 2):
        masks = simhash.covering_masks(radius, 0)
        assert len(masks) == (1 << radius + 1) - 1
        for bits in itertools.combinations(range(64), radius):
            difference = sum(1 << b for b in bits)
            assert any(m & ((1 << 64) - 1) & difference == 0 for m in masks)
    masks = [m & ((1 << 64) - 1) for m in simhash.covering_masks(4, 3)]
    rng = np.random.default_rng(0)
    for _ in range(3000):
        difference = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(m & difference == 0 for m in masks)


def test_fingerprints_equal_spark_hashes(spark):
    text = "one two three four"
    value = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0] & ((1 << 64) - 1)
    assert simhash.fingerprint(text.upper()) == value == plain_fingerprint(text)


@pytest.mark.parametrize("bucket_rows", [40, 10_000])
def test_roots_of_a_dense_ball(spark, bucket_rows):
    rng = np.random.default_rng(1)
    values = set()
    for _ in range(90):
        x = 0x923456789ABCDEF0
        for b in rng.choice(64, rng.integers(0, 5), replace=False):
            x ^= 1 << int(b)
        values.add(x)
    values |= {int(x) for x in rng.integers(0, 1 << 64, 60, dtype=np.uint64)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.fp: r.root for r in simhash.fingerprint_roots(df, 4, bucket_rows).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for i, c in enumerate(plain_classes(values)):
        got[roots[signed[i]]].add(i)
        want[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components.components(df.limit(0)).collect() == []


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    values = [plain_fingerprint(d.text) for d in docs]
    classes = plain_classes(values)
    rows = {r.doc_id: r for r in simhash.op9_simhash(spark, SMALL).collect()}
    for d, v, c in zip(docs, values, classes):
        assert rows[d.doc_id].fingerprint == f"{v:016x}"
        assert rows[d.doc_id].component_id == docs[c].doc_id


# --- sharding -----------------------------------------------------------------------------------

def test_quotas_keep_counts():
    rng = np.random.default_rng(3)
    for _ in range(50):
        wants = {(a, b): int(rng.integers(0, 9)) for a in range(5) for b in range(5) if a != b}
        free = {a: int(rng.integers(0, 12)) for a in range(5)}
        change, used = collections.Counter(), collections.defaultdict(list)
        for shard, lane, first, end, to in sharding.quotas(wants, free):
            change[shard] -= end - first
            change[to] += end - first
            used[shard, lane].append((first, end))
            assert end <= (free[shard] if lane == sharding.FREE else wants[shard, lane])
        assert not any(change.values())
        for spans in used.values():
            spans.sort()
            assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def shards_of(df, **options):
    rows = sharding.balanced_shards(df, **options).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return rows, [len(slots[s]) for s in sorted(slots)]


def test_hot_group_and_small_groups(spark):
    texts = ["hot"] * 150 + [f"group {i // 3}" for i in range(90)] + [f"own {i}" for i in range(161)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows, counts = shards_of(df, shards=8, bucket_rows=16)
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(texts)
    held = collections.defaultdict(collections.Counter)
    for r in rows:
        held[texts[r.doc_id]][r.shard] += 1
    assert len(held["hot"]) <= 4           # it fills three shards of 50
    assert sum(len(held[f"group {i}"]) > 1 for i in range(30)) <= 2


def test_odd_rows(odd, none):
    rows, counts = shards_of(odd.select("*"), shards=3)
    assert counts == [3, 3, 3]
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in rows}
    assert sizes[3] == sizes[2] == (8, 0)
    assert sharding.balanced_shards(none, shards=3).collect() == []


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    rows = sharding.op2_balanced_shards(spark, SMALL).collect()
    assert len(rows) == docs and {r.law for r in rows} == {"rows"}
    counts = collections.Counter(r.shard for r in rows)
    assert len(counts) == 24 and max(counts.values()) - min(counts.values()) <= 1
