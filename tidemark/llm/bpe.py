"""Operator 3: byte-level BPE encoding and decoding.

``encode`` keeps the input's columns and adds ``ids`` (token ids as little-endian unsigned 32-bit
integers) and ``offsets`` (the byte of the text at which each token starts, same form).
``decode`` adds ``decoded``, the bytes those ids stand for.  Both are one pass without a shuffle.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes;
repeated rows stay; an input column named like an output is replaced; an empty table gives an
empty table.  A text is always encoded whole, however long.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import (
    PieceCache,
    map_texts,
    read_table,
    text_slices,
    worker_store,
)
from tidemark.llm.pretokens import pieces_of, split_texts
from tidemark.runtime import ship_by_value

ship_by_value(__name__)

RANK_FILE = "byte_bpe_50k.tiktoken"
SHORT_PIECE = 32               # bytes up to which pieces are merged side by side
ROWS = 8_192                   # pieces merged side by side
NO_RANK = 1 << 31
GONE = -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Join the adjacent pair of lowest rank, leftmost first, until no pair has a rank.

    A heap of candidate pairs over a linked list keeps a piece of n bytes at n log n.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))            # where the part that starts here ends; 0: no part
    previous = list(range(-1, n - 1))
    heap = []

    def offer(left: int) -> None:
        middle = end[left]
        if middle < n and (rank := ranks.get(piece[left:end[middle]])) is not None:
            heapq.heappush(heap, (rank, left, middle, end[middle]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, left, middle, right = heapq.heappop(heap)
        if end[left] != middle or end[middle] != right:
            continue                       # one of the two has been joined meanwhile
        end[left], end[middle] = right, 0
        if right < n:
            previous[right] = left
        offer(left)
        if previous[left] >= 0:
            offer(previous[left])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:end[at]]])
        at = end[at]
    return ids


class Merger:
    """Pair merging of many short pieces at a time: one row of parts a piece, one merge a round."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        pairs = {(ranks[t[:i]] << 32) | ranks[t[i:]]: rank for t, rank in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank, and so id, of the joined pair, or ``NO_RANK``."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.joined[at], NO_RANK)

    def short(self, pieces: list[bytes]) -> list[np.ndarray]:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8)
        parts = self.bytes[raw].reshape(-1, width)
        columns = np.arange(width)
        parts[columns >= lengths[:, None]] = GONE
        pairs = np.full(parts.shape, NO_RANK, np.int64)
        there = columns[:-1] < lengths[:, None] - 1
        pairs[:, :-1][there] = self.rank(parts[:, :-1][there], parts[:, 1:][there])
        work = np.arange(len(pieces))
        while True:
            at = pairs[work].argmin(1)
            lowest = pairs[work, at]
            live = lowest < NO_RANK
            work, at, lowest = work[live], at[live], lowest[live]
            if not len(work):
                return [row[row != GONE] for row in parts]
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            moved = np.take_along_axis(parts[work], source, 1)
            ranks = np.take_along_axis(pairs[work], source, 1)
            moved[:, -1], ranks[:, -1] = GONE, NO_RANK
            row = np.arange(len(work))
            moved[row, at] = lowest
            after = np.minimum(at + 1, width - 1)
            ranks[row, at] = np.where((at + 1 < width) & (moved[row, after] != GONE),
                                      self.rank(lowest, moved[row, after]), NO_RANK)
            has = at > 0
            ranks[row[has], at[has] - 1] = self.rank(moved[row[has], at[has] - 1], lowest[has])
            parts[work], pairs[work] = moved, ranks

    def ids(self, pieces: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every piece."""
        raw = [p.encode() for p in pieces]
        out: list[bytes] = [b""] * len(raw)
        sizes: dict[int, list[int]] = {}
        for i, p in enumerate(raw):
            if (known := self.ranks.get(p)) is not None:
                out[i] = known.to_bytes(4, "little")
            elif len(p) <= SHORT_PIECE:
                sizes.setdefault(len(p) + 7 >> 3, []).append(i)
            else:
                out[i] = np.array(merge_pairs(p, self.ranks), np.uint32).tobytes()
        for places in sizes.values():
            for k in range(0, len(places), ROWS):
                some = places[k:k + ROWS]
                for i, ids in zip(some, self.short([raw[i] for i in some])):
                    out[i] = ids.astype(np.uint32).tobytes()
        return out


class Vocabulary:
    """All tokens' bytes in one buffer, by id."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.buffer = np.frombuffer(b"".join(tokens), np.uint8)

    def starts(self, ids: np.ndarray) -> np.ndarray:
        """Byte at which each token of a text starts."""
        lengths = self.lengths[ids]
        return np.cumsum(lengths) - lengths

    def join(self, ids: np.ndarray, starts: np.ndarray) -> bytes:
        """The tokens' bytes, each laid at its offset."""
        lengths = self.lengths[ids]
        source = np.arange(int(lengths.sum())) + np.repeat(self.places[ids] - starts, lengths)
        return self.buffer[source].tobytes()


def _merged(path: str) -> PieceCache:
    store = worker_store()
    if ("bpe", path) not in store:
        store["bpe", path] = PieceCache(Merger(read_ranks(path)).ids)
    return store["bpe", path]


def _vocabulary(path: str) -> Vocabulary:
    store = worker_store()
    if ("vocabulary", path) not in store:
        store["vocabulary", path] = Vocabulary(read_ranks(path))
    return store["vocabulary", path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` and ``offsets``; ``path`` names the rank file on the executors."""

    def run(texts: list[str]) -> dict[str, pa.Array]:
        vocabulary = _vocabulary(path)
        joined, bounds, firsts = split_texts(texts)
        coded = _merged(path).of(pieces_of(joined, bounds))
        edges = firsts.tolist()
        ids = [b"".join(coded[a:b]) for a, b in zip(edges, edges[1:])]
        offsets = [vocabulary.starts(np.frombuffer(x, np.uint32)).astype(np.uint32).tobytes()
                   for x in ids]
        return {"ids": pa.array(ids, pa.binary()), "offsets": pa.array(offsets, pa.binary())}

    return map_texts(docs, text, "ids binary, offsets binary", run)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of its ids."""
    schema = type(encoded.schema)([f for f in encoded.schema if f.name.lower() != "decoded"])
    out = type(schema)(list(schema)).add("decoded", "binary")
    names = list(out.names)

    def run(batches):
        vocabulary = _vocabulary(path)
        for part in (p for batch in batches for p in text_slices(batch, "ids")):
            decoded = []
            for ids, starts in zip(part.column("ids"), part.column("offsets")):
                decoded.append(vocabulary.join(np.frombuffer(ids.as_py() or b"", np.uint32),
                                               np.frombuffer(starts.as_py() or b"", np.uint32)))
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in names[:-1]] + [pa.array(decoded, pa.binary())],
                names=names)

    return encoded.select(*[F.col(f"`{c}`") for c in schema.names]).mapInArrow(run, out)


def token_count() -> F.Column:
    return (F.length("ids") / 4).cast("long")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes they decode to."""
    path = public_tokenizers.path(RANK_FILE)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode(docs, path).select("doc_id", "ids", "offsets")
    return decode(encoded, path).select(
        "doc_id", token_count().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
