"""Operator 9: near duplicates by SimHash and covering masks.

Every text gets a 64-bit fingerprint; fingerprints that differ in at most ``radius`` bits are linked
and the classes of linked documents are their connected components.

The masks cover: give every bit a vector of radius + 1 binary digits, and for every such vector
other than zero take the bits whose vectors have an odd product with it.  Up to ``radius`` vectors
never span the space, so for any so many differing bits some mask avoids them all: the pair has the
same key under it.  With a radius of 4 these are 31 tables, and no pair is lost.

Equal fingerprints are one row before anything is paired.  A bucket of a table is walked in its
task, which returns a spanning forest of its links, at most one link a member, and holds at most
``bucket_rows`` members.  The members of a larger bucket are returned unlinked and dealt again by
finer masks that cover the bits their bucket leaves open, until no bucket is larger.

Defined results: a null or empty text, or one without words, has the fingerprint zero and is linked
like any other; a null id is never a component's id unless all of its members' are null; repeated
rows stay; an empty table gives an empty table.  Other columns cannot clash with working columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts, read_table
from tidemark.llm.components import components
from tidemark.runtime import materialize, ship_by_value

ship_by_value(__name__)

SHINGLE = 4
RADIUS = 4
BITS = 64
HASH_SEED = 42
BUCKET_ROWS = 8_192
BLOCK = 1 << 16


def fingerprint(text: str) -> int:
    """Majority of the bits of the XXH64 of all word shingles."""
    words = text.encode().lower().split()  # ASCII letters and white space only
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), HASH_SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], HASH_SEED)
                       for a, b in zip(starts, ends[SHINGLE - 1:].tolist())], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        some = hashes[i:i + BLOCK].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(some, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint_bits``, a signed long."""

    def run(texts: list[str]) -> dict[str, pa.Array]:
        bits = np.array([fingerprint(t) for t in texts], np.uint64)
        return {"fingerprint_bits": pa.array(bits.view(np.int64), pa.int64())}

    return map_texts(docs, text, "fingerprint_bits long", run)


def covering_masks(radius: int, level: int) -> list[int]:
    """The masks of one level, as signed longs; levels deal the bits differently."""
    size = (1 << radius + 1) - 1
    order = np.random.default_rng(level).permutation(BITS).tolist()
    vectors = [1 + place % size for place in order]
    masks = [sum(1 << bit for bit, vector in enumerate(vectors) if (vector & v).bit_count() & 1)
             for v in range(1, size + 1)]
    return [m - (1 << BITS) if m >> BITS - 1 else m for m in masks]


def differing(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Number of differing bits.  A count of a signed number's bits leaves out its sign."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(members: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the members' links."""
    left, right = [], []
    rest = members
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            one = stack.pop()
            near = differing(rest, one) <= radius
            if near.any():
                found = rest[near]
                rest = rest[~near]
                left.append(np.full(len(found), one))
                right.append(found)
                stack += found.tolist()
    return left, right


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int,
                  bucket_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (mask, key) to links, or to (a, null, mask) for members of large buckets."""
    held: list[tuple] = []                 # the bucket that may go on in the next batch
    size, large = 0, None

    def links(left, right):
        return pa.RecordBatch.from_arrays(
            [pa.array(left, pa.int64()), pa.array(right, pa.int64()),
             pa.nulls(len(left), pa.int64())], names=["a", "b", "mask"])

    def members(rows, mask):
        return pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.nulls(len(rows), pa.int64()),
             pa.array(np.full(len(rows), mask), pa.int64())], names=["a", "b", "mask"])

    def walked(mask, key, fp):
        """Links of complete buckets."""
        edges = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.append(0, edges)
        counts = np.diff(np.append(starts, len(fp)))
        pairs = starts[counts == 2]
        one, other = fp[pairs], fp[pairs + 1]
        near = differing(one, other) <= radius
        left, right = [one[near]], [other[near]]
        for s, n in zip(starts[counts > 2].tolist(), counts[counts > 2].tolist()):
            if n > bucket_rows:
                yield members(fp[s:s + n], mask[s])
                continue
            a, b = forest(fp[s:s + n], radius)
            left += a
            right += b
        yield links(np.concatenate(left), np.concatenate(right))

    for batch in batches:
        mask, key, fp = (batch.column(c).to_numpy() for c in ("mask", "key", "fp"))
        if not len(fp):
            continue
        if held and (mask[0], key[0]) != (held[0][0][0], held[0][1][0]):
            yield from walked(*map(np.concatenate, zip(*held)))
            held, size = [], 0
        if large and large != (mask[0], key[0]):
            large = None
        last = (mask[-1], key[-1])
        cut = int(np.flatnonzero((mask != last[0]) | (key != last[1]))[-1]) + 1 if (
            (mask[0], key[0]) != last) else 0
        if cut:
            done = 0
            if large:                      # its end is in this batch
                done = int(np.flatnonzero((mask != large[0]) | (key != large[1]))[0])
                yield members(fp[:done], large[0])
                large = None
            held.append((mask[done:cut], key[done:cut], fp[done:cut]))
            yield from walked(*map(np.concatenate, zip(*held)))
            held, size = [], 0
        tail = mask[cut:], key[cut:], fp[cut:]
        if large:
            yield members(tail[2], large[0])
            continue
        held.append(tail)
        size += len(tail[2])
        if size > bucket_rows:             # too large already: hand its members on as they come
            large = last
            for rows in held:
                yield members(rows[2], last[0])
            held, size = [], 0
    if held:
        yield from walked(*map(np.concatenate, zip(*held)))


def fingerprint_links(fingerprints: DataFrame, radius: int = RADIUS,
                      bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that connect whatever is
    connected by differences of at most ``radius`` bits."""
    open_rows = fingerprints.select("fp", F.lit(0).cast("long").alias("mask"))
    out, level = None, 0
    while True:
        masks = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius, level)])
        dealt = open_rows.select("fp", F.explode(masks).alias("more"), "mask").select(
            "fp", F.expr("mask | more").alias("mask"))
        dealt = dealt.withColumn("key", F.expr("fp & mask"))
        if level:
            dealt = dealt.distinct()       # two large buckets may share a finer one
        dealt = dealt.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        found = materialize(dealt.mapInArrow(
            lambda batches: _bucket_links(batches, radius, bucket_rows),
            "a long, b long, mask long"), "bucket-links")
        links = found.where("mask IS NULL").select("a", "b")
        out = links if out is None else out.unionByName(links)
        open_rows = found.where("mask IS NOT NULL").select(F.col("a").alias("fp"), "mask")
        if open_rows.isEmpty():
            return out
        level += 1


def fingerprint_roots(fingerprints: DataFrame, radius: int = RADIUS,
                      bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, root) for every distinct fingerprint."""
    linked = components(fingerprint_links(fingerprints, radius, bucket_rows))
    joined = fingerprints.join(linked, F.col("fp") == F.col("node"), "left")
    return joined.select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(rows: DataFrame, key: Column, radius: int = RADIUS,
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(fp, component): for every fingerprint of ``rows`` (stored, with ``fingerprint_bits``) the
    smallest non-null ``key`` of its class."""
    classes = rows.groupBy(F.col("fingerprint_bits").alias("fp")).agg(F.min(key).alias("least"))
    classes = materialize(classes, "fingerprint-classes")
    roots = classes.join(fingerprint_roots(classes.select("fp"), radius, bucket_rows), "fp")
    least = roots.groupBy("root").agg(F.min("least").alias("component"))
    return roots.join(least, "root").select("fp", "component")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = materialize(with_fingerprint(docs).select("doc_id", "fingerprint_bits"), "fingerprints")
    classes = near_duplicates(rows, F.col("doc_id"))
    shown = F.lower(F.lpad(F.hex("fingerprint_bits"), 16, "0"))
    return rows.join(classes, F.col("fingerprint_bits") == F.col("fp")).select(
        "doc_id", shown.alias("fingerprint"), F.col("component").alias("component_id"))
