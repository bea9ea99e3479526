"""Operator 7: documents that contain a benchmark item, up to edits.

Texts and items are compared as lower-cased words.  A window of a text holds an item of m words if
at most ``1 - SIMILARITY`` of m words must be edited.  Candidates come from item-sized windows at
every word by locality-sensitive hashing of their CGK embedding: a random walk copies words and
moves on by a random bit that depends on the step and the word, so that two sequences that differ
by few edits soon walk in step again and agree in most places of their embeddings.  Each of
``WALKS`` walks samples ``SAMPLES`` places for every size of window; equal samples make a candidate,
and a dynamic programme then gives its exact edit distance.  Walks drift apart on long sequences, so
items of more than ``PIECE`` words are sought by equal pieces of at most so many: one of them has no
larger share of edits than the whole, and any of them that is found makes the item a candidate.

Windows are embedded only where a match can be: edits cut an item into at most edits + 1 runs, so
one run of (m - edits) / (edits + 1) words stays whole, and a stretch of text without such a run
of words of any item cannot hold one.

Items are a stated query set.  They are taken in blocks of at most ``BLOCK_WORDS`` words, one pass
over the texts a block.  The passes are chained in one plan, so the driver holds every block and a
task one block for each of its workers: memory grows with the items beyond one block.

Defined results: a null or empty text holds nothing; an item without words is never found; repeated
rows and repeated items are reported each; an item found more than once in a text is reported once,
with the fewest edits; an empty table on either side finds nothing.  An input column named
``leaks`` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts, read_table, worker_store
from tidemark.runtime import ship_by_value

ship_by_value(__name__)

SIMILARITY = 0.8
WALKS = 32
SAMPLES = 3
PIECE = 60                     # words; up to here the walks meet their recall at 20 per cent edits
SIZE_RATIO = 1.2               # pieces within this ratio of words share samples
BLOCK_WORDS = 500_000
STARTS = 256                   # windows embedded at a time
SEED = 7

LEAK = pa.struct([("item_id", pa.int64()), ("edits", pa.int64()), ("item_words", pa.int64())])
WORD = re.compile(r"\w+")

Item = tuple[int | None, list[str]]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def item_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                block_words: int = BLOCK_WORDS) -> Iterator[list[Item]]:
    """The items with words, a block at a time."""
    rows = benchmark.select(F.col(item).cast("long"), F.col(text).cast("string"))
    block: list[Item] = []
    size = 0
    for key, value in rows.where(F.col(text).isNotNull()).toLocalIterator():
        words = words_of(value)
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        if words:
            block.append((key, words))
            size += len(words)
    if block:
        yield block


def allowed(words: int, similarity: float) -> int:
    return int(words * (1 - similarity) + 1e-9)


def fewest_edits(item: np.ndarray, text: np.ndarray) -> int:
    """Smallest edit distance between the item and any window of the text."""
    places = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for word in item:
        after = row + 1
        after[1:] = np.minimum(after[1:], row[:-1] + (text != word))
        row = np.minimum.accumulate(after - places) + places
    return int(row.min())


def walk_moves(step: int, symbols: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """The random bit of (walk, step, word), the same wherever it is asked for."""
    x = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= salts + np.uint64(step * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) & np.uint64(1)


class Finder:
    """One block of items with its hash tables."""

    def __init__(self, items: list[Item], similarity: float, walks: int, samples: int) -> None:
        self.items = items
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary.setdefault
        self.coded = [np.array([number(w, len(self.vocabulary) + 1) for w in words], np.int64)
                      for _, words in items]
        sizes = np.array([len(c) for c in self.coded])
        self.edits = np.array([allowed(n, similarity) for n in sizes])
        # Runs of words of which a text must have one, by length, and how far an item can reach.
        self.runs: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
        for c, n, k in zip(self.coded, sizes.tolist(), self.edits.tolist()):
            length = -(-(n - k) // (k + 1))
            for i in range(n - length + 1):
                run = tuple(c[i:i + length].tolist())
                self.runs[length][run] = max(n + k, self.runs[length].get(run, 0))
        # For the exact bound on shared words: word -> items that have it, and how often.
        self.having: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, c in enumerate(self.coded):
            for word, n in Counter(c.tolist()).items():
                self.having[word].append((i, n))
        # Size classes and, for each, the places that every walk samples.
        self.samples = samples
        rng = np.random.default_rng(SEED)
        self.salts = rng.integers(1 << 62, size=walks).astype(np.uint64)
        pieces = [(i, piece) for i, c in enumerate(self.coded)
                  for piece in np.array_split(c, -(-len(c) // PIECE))]
        lengths = np.array([len(piece) for _, piece in pieces])
        starts: list[int] = []
        for n in np.sort(lengths).tolist():
            if not starts or n > starts[-1] * SIZE_RATIO:
                starts.append(n)
        classes = np.searchsorted(starts, lengths, side="right") - 1
        self.places = [np.stack([np.sort(rng.choice(2 * n, min(samples, 2 * n), replace=False))
                                 for _ in range(walks)]) for n in starts]
        self.mixers = [rng.integers(1 << 62, size=p.shape).astype(np.uint64) | np.uint64(1)
                       for p in self.places]
        self.steps = int(max(p.max() for p in self.places)) + 1
        keys, owners = [], []
        for (i, piece), size_class in zip(pieces, classes):
            embedded = self.embed(piece, np.zeros(1, np.int64))
            k = self.keys(embedded, size_class).ravel()
            keys.append(k)
            owners.append(np.full(len(k), i))
        flat = np.concatenate(keys)
        by_key = np.argsort(flat, kind="stable")
        self.key_table, self.owner_table = flat[by_key], np.concatenate(owners)[by_key]

    def embed(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """CGK embeddings (step, walk, start) of the words from each start on."""
        padded = np.append(words, 0)
        at = np.broadcast_to(starts, (len(self.salts), len(starts))).copy()
        out = np.empty((self.steps, *at.shape), np.int64)
        for step in range(self.steps):
            symbols = padded[at]
            out[step] = symbols
            at += walk_moves(step, symbols, self.salts[:, None]).astype(np.int64)
            np.minimum(at, len(words), out=at)
        return out

    def keys(self, embedded: np.ndarray, size_class: int) -> np.ndarray:
        """Hashes of the sampled places, (walk, start)."""
        walks = np.arange(len(self.salts))
        places, mixers = self.places[size_class], self.mixers[size_class]
        key = self.salts[:, None] + np.uint64(size_class)
        for s in range(places.shape[1]):
            sampled = embedded[places[:, s], walks].astype(np.uint64)
            key = (key ^ (sampled * mixers[:, s, None])) * np.uint64(0x9FB21C651E98DF25)
            key ^= key >> np.uint64(32)
        return key

    def regions(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of text that can hold an item, disjoint."""
        known = codes > 0
        found = []
        for length, runs in self.runs.items():
            n = len(codes) - length + 1
            if n <= 0:
                continue
            whole = known[:n].copy()
            for i in range(1, length):
                whole &= known[i:n + i]
            for p in np.flatnonzero(whole).tolist():
                if reach := runs.get(tuple(codes[p:p + length].tolist())):
                    found.append((max(0, p - reach), min(len(codes), p + length + reach)))
        out: list[tuple[int, int]] = []
        for low, high in sorted(found):
            if out and low <= out[-1][1]:
                out[-1] = out[-1][0], max(high, out[-1][1])
            else:
                out.append((low, high))
        return out

    def candidates(self, words: np.ndarray) -> set[int]:
        """Items with a piece whose samples equal those of some window of the words, by some walk."""
        found: set[int] = set()
        for low in range(0, len(words), STARTS):
            starts = np.arange(low, min(low + STARTS, len(words)))
            embedded = self.embed(words, starts)
            for size_class in range(len(self.places)):
                keys = np.unique(self.keys(embedded, size_class))
                left = np.searchsorted(self.key_table, keys)
                right = np.searchsorted(self.key_table, keys, side="right")
                for a, b in zip(left[right > left].tolist(), right[right > left].tolist()):
                    found.update(self.owner_table[a:b].tolist())
        return found

    def close(self, words: np.ndarray, items: set[int]) -> dict[int, int]:
        """Items within their allowed edits of some window, with the fewest edits."""
        shared: Counter[int] = Counter()
        for word, n in Counter(words[words > 0].tolist()).items():
            for i, m in self.having[word]:
                shared[i] += min(n, m)
        out = {}
        for i in items:
            code, most = self.coded[i], int(self.edits[i])
            if shared[i] >= len(code) - most:
                edits = fewest_edits(code, words)
                if edits <= most:
                    out[i] = edits
        return out

    def leaks(self, text: str) -> list[dict]:
        code = self.vocabulary.get
        codes = np.array([code(w, 0) for w in words_of(text)], np.int64)
        best: dict[int, int] = {}
        for low, high in self.regions(codes):
            words = codes[low:high]
            for i, edits in self.close(words, self.candidates(words)).items():
                best[i] = min(edits, best.get(i, edits))
        return [{"item_id": self.items[i][0], "edits": e, "item_words": len(self.coded[i])}
                for i, e in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text",
               similarity: float = SIMILARITY, walks: int = WALKS, samples: int = SAMPLES,
               block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``leaks``: item_id, edits and item_words of every item that a text holds."""
    kind = "array<struct<item_id:bigint,edits:bigint,item_words:bigint>>"
    out = docs.withColumn("leaks", F.array().cast(kind))
    for items in item_blocks(benchmark, block_words=block_words):
        out = _with_block(out, items, text, similarity, walks, samples)
    return out


def _with_block(docs: DataFrame, items: list[Item], text: str, similarity: float, walks: int,
                samples: int) -> DataFrame:
    name = f"finder {hash((similarity, walks, samples, str(items)))}"

    def run(texts: list[str]) -> dict[str, pa.Array]:
        store = worker_store()
        if name not in store:
            for old in [k for k in store if str(k).startswith("finder ")]:
                del store[old]
            store[name] = Finder(items, similarity, walks, samples)
        return {"leaks of block": pa.array([store[name].leaks(t) for t in texts], pa.list_(LEAK))}

    before = docs.withColumnRenamed("leaks", "leaks so far")
    found = map_texts(before, text, "`leaks of block` array<struct<item_id:bigint,edits:bigint,"
                      "item_words:bigint>>", run)
    return found.withColumn("leaks", F.concat("leaks so far", "leaks of block")).drop(
        "leaks so far", "leaks of block")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) such that the text holds the item."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
