"""Near duplicates of the pipeline: texts that share most of their runs of five words.

Two texts are linked if their fingerprints differ in at most 4 bits, as in operator 9, or if the
Jaccard similarity of their sets of five-word shingles is at least ``SIMILARITY``; classes are the
connected components.  Fingerprints alone miss most pairs near that similarity.

Candidates share one of ``BANDS`` keys, each of ``ROWS`` minima of seeded hashes over the shingles:
a pair at 0.8 shares none with probability (1 - 0.8 ** 5) ** 24, which is 7 in 100,000, and a closer
pair less often.  Candidates are then compared by all their shingles (64-bit hashes of them).

Texts with equal shingles and fingerprint are one row, and only buckets that hold more than one
class are walked, so copies cost nothing; of buckets with the same members one is walked.  Which
buckets these are is found once, on rows without texts, and their members' texts are stored once,
compressed (hashes would take more room and do not compress).  The bands are walked in three steps,
and what one step has linked is one class in the next, so most of these texts are sent for two bands
and few for all.  A bucket is walked in its task by whole sets; one of more than ``BUCKET_SHINGLES``
is cut into parts, and every pair of parts is a task, so no pair is lost and no task holds more.
Where nothing in such a bucket is similar, that work is quadratic in its parts, as an exact
comparison demands.

Defined results: shingles are of words as in operator 9; a text of fewer words is one shingle; one
without words is similar by its fingerprint only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import map_texts, release_caches
from tidemark.llm.components import components
from tidemark.runtime import materialize, ship_by_value

ship_by_value(__name__)

SHINGLE = 5
SIMILARITY = 4, 5              # as a fraction
BANDS = 24
ROWS = 5
STEPS = 0, 2, 8, BANDS         # bands walked together
BUCKET_SHINGLES = 4_000_000
BLOCK = 4_096                  # shingles hashed at a time
SEED = 11

_rng = np.random.default_rng(SEED)
SALTS = _rng.integers(1 << 63, size=BANDS * ROWS).astype(np.uint64)
FACTORS = _rng.integers(1 << 63, size=BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
del _rng


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of the runs of words."""
    words = text.encode().lower().split()
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    length = min(SHINGLE, len(words))
    runs = np.full(len(words) - length + 1 if length else 0, SEED, np.uint64)
    for i in range(length):
        runs = (runs ^ own[i:i + len(runs)]) * np.uint64(0x9FB21C651E98DF25)
        runs ^= runs >> np.uint64(32)
    return np.unique(runs)


def pack(text: str) -> bytes:
    """The text's bytes compressed, behind their number."""
    data = text.encode()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unpack(packed: bytes) -> str:
    size = int.from_bytes(packed[:8], "little")
    return pa.decompress(packed[8:], size, codec="zstd", asbytes=True).decode()


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band."""
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        some = (hashes[i:i + BLOCK, None] ^ SALTS) * FACTORS
        least = np.minimum(least, some.min(0))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9FB21C651E98DF25)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def with_bands(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with fingerprint_bits, two hashes of the set of shingles, its size and its keys."""

    def run(texts: list[str]) -> dict[str, pa.Array]:
        release_caches()
        sets = [shingles(t) for t in texts]
        bits = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
        a, b = (np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64)
                for seed in (0, 1))
        keys = [band_keys(s) if len(s) else [] for s in sets]
        return {"fingerprint_bits": pa.array(bits.view(np.int64), pa.int64()),
                "set_a": pa.array(a.view(np.int64), pa.int64()),
                "set_b": pa.array(b.view(np.int64), pa.int64()),
                "n_shingles": pa.array(list(map(len, sets)), pa.int64()),
                "bands": pa.array(keys, pa.list_(pa.int64()))}

    return map_texts(docs, text, "fingerprint_bits long, set_a long, set_b long, n_shingles long, "
                     "bands array<long>", run)


def bucket_links(roots: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect the roots whose sets, none of them empty, are similar."""
    part, whole = SIMILARITY
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    own = np.split(codes, np.cumsum(sizes)[:-1])
    mark = np.zeros(codes.max() + 1, np.uint8)
    waiting = np.ones(len(sets), bool)
    listed = np.arange(len(sets))          # members that ``codes`` lists
    links: list[tuple[int, int]] = []

    def take(root: int) -> list[int]:
        found = np.flatnonzero(waiting & (roots == root))
        waiting[found] = False
        return found.tolist()

    while waiting.any():
        stack = take(roots[np.argmax(waiting)])
        while stack and (left := np.count_nonzero(waiting)):
            if 2 * left < len(listed):
                listed = np.flatnonzero(waiting)
                codes = np.concatenate([own[i] for i in listed])
            one = stack.pop()
            mark[own[one]] = 1
            starts = np.append(0, np.cumsum(sizes[listed])[:-1])
            shared = np.add.reduceat(mark[codes], starts, dtype=np.int64)
            mark[own[one]] = 0
            # shared / (sum of sizes - shared) >= part / whole
            near = shared * (part + whole) >= part * (sizes[one] + sizes[listed])
            for root in set(roots[listed[near & waiting[listed]]].tolist()):
                links.append((int(roots[one]), root))
                stack += take(root)
    return links


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (band, key, low, high) to links between roots."""
    names = "band", "key", "low", "high"
    held: list[tuple[int, np.ndarray]] = []
    last = None

    def links() -> pa.RecordBatch:
        found = bucket_links(np.array([r for r, _ in held], np.int64), [s for _, s in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        buckets = zip(*(batch.column(c).to_pylist() for c in names))
        for bucket, root, own in zip(buckets, batch.column("root").to_pylist(),
                                     batch.column("packed")):
            if bucket != last:
                if held:
                    yield links()
                held, last = [], bucket
            held.append((root, shingles(unpack(own.as_py()))))
    if held:
        yield links()


def mixed_buckets(units: DataFrame) -> DataFrame:
    """Members (band, key, row_id, fp, n_shingles) of the buckets that hold several roots.

    ``units`` has row_id, fp, root, n_shingles and bands.  Buckets are the same if the sums of two
    hashes of their members are; the one of the first band stands for them, as comparing the same
    texts again would find nothing new.
    """
    dealt = units.select("row_id", "fp", "root", "n_shingles",
                         F.posexplode("bands").alias("band", "key"))
    buckets = dealt.groupBy("band", "key").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("row_id")).alias("a"),
        F.bit_xor(F.xxhash64("row_id", F.lit(SEED))).alias("b")).where("low <> high")
    first = buckets.groupBy("a", "b", "n").agg(
        F.min(F.struct("band", "key")).alias("bucket")).select("bucket.*")
    # Merged at every size, as the number of such buckets grows with the input.
    return dealt.join(first.hint("merge"), ["band", "key"]).select("band", "key", "row_id", "fp", "n_shingles")


def packed_texts(stored: DataFrame, text: str, members: DataFrame) -> DataFrame:
    """(row_id, packed) of the members."""

    def run(texts: list[str]) -> dict[str, pa.Array]:
        return {"packed": pa.array(map(pack, texts), pa.binary())}

    # Stored, so that its size is known before the texts would be shuffled for it.
    wanted = materialize(members.select("row_id").distinct(), "band-wanted")
    texts = stored.select("row_id", F.col(f"`{text}`").alias("text")).join(
        wanted, "row_id", "left_semi")
    return map_texts(texts, "text", "packed binary", run).drop("text")


def similar_links(texts: DataFrame, members: DataFrame,
                  bucket_shingles: int = BUCKET_SHINGLES) -> DataFrame:
    """Links (a, b) between the roots of ``members`` whose texts are similar and share a bucket.

    ``texts`` has the packed texts by ``row_id``; ``members`` those of ``mixed_buckets`` with their
    present ``root``.
    """
    buckets = members.groupBy("band", "key").agg(
        F.sum("n_shingles").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    parts = F.when(F.col("n") > bucket_shingles,
                   F.ceil(2 * F.col("n") / F.lit(bucket_shingles))).otherwise(1)
    buckets = buckets.where("low <> high").select("band", "key", parts.cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("row_id"), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("low"),
                                                         F.lit(0).alias("high"))))
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part"))
    pairs = pairs.otherwise(F.transform(others, lambda x: F.struct(
        F.least(x, "part").alias("low"), F.greatest(x, "part").alias("high"))))
    dealt = members.join(buckets, ["band", "key"]).withColumn("part", part).select(
        "row_id", "root", "band", "key", "parts", "part")
    # Merged at every size, as the list of members grows with the input.
    placed = texts.join(dealt.hint("merge"), "row_id").select(
        "band", "key", "root", "packed", F.explode(pairs).alias("p")).select(
        "band", "key", "p.low", "p.high", "root", "packed")
    bucket = "band", "key", "low", "high"
    placed = placed.repartition(*bucket).sortWithinPartitions(*bucket)
    return placed.mapInArrow(_walk, "a long, b long")


def near_duplicates(stored: DataFrame, text: str, key: Column,
                    bucket_shingles: int = BUCKET_SHINGLES) -> DataFrame:
    """(fp, component): for every fingerprint of ``stored`` the smallest ``key`` of its class.

    The bands are walked in ``STEPS``.  What the first ones link is one class for the later ones,
    which therefore get only the texts of buckets that still hold several classes.
    """
    classes = stored.groupBy(F.col("fingerprint_bits").alias("fp")).agg(F.min(key).alias("least"))
    classes = materialize(classes, "fingerprint-classes")
    roots = materialize(simhash.fingerprint_roots(classes.select("fp")), "fingerprint-roots")
    # Texts with equal shingles are one row; the other rows of theirs have the same fingerprint.
    units = stored.where("n_shingles > 0").groupBy(
        F.col("fingerprint_bits").alias("fp"), "set_a", "set_b").agg(F.min("row_id").alias("row_id"))
    units = stored.select("row_id", "n_shingles", "bands").join(
        units.select("row_id", "fp"), "row_id")
    units = materialize(units.join(roots, "fp"), "band-units")
    members = materialize(mixed_buckets(units), "band-members")
    texts = materialize(packed_texts(stored, text, members), "band-texts")
    for low, high in zip(STEPS, STEPS[1:]):
        some = members.where((F.col("band") >= low) & (F.col("band") < high)).join(roots, "fp")
        linked = components(similar_links(texts, some, bucket_shingles)).select(
            "node", F.col("root").alias("joined"))
        roots = materialize(roots.join(linked, F.col("root") == F.col("node"), "left").select(
            "fp", F.coalesce("joined", "root").alias("root")), "fingerprint-roots")
    rows = classes.join(roots, "fp")
    least = rows.groupBy("root").agg(F.min("least").alias("component"))
    return rows.join(least, "root").select("fp", "component")
