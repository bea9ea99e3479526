"""Operator 10: token counts under a unigram model, shared along a trie of pre-tokens.

The model gives every vocabulary entry a cost that follows Zipf's law of its rank, in whole numbers
so that sums are exact.  A pre-token's count is the number of tokens of its cheapest segmentation,
the fewest among equally cheap ones.  The forward score of a prefix depends on that prefix alone,
so words that share one share its score: the distinct pre-tokens of a slice, sorted, are a trie in
depth-first order, and one stack holds the scores along the current path.  Terminal counts are kept
in the worker's cache, and documents only sum them up.  One pass, no shuffle.

Defined results: a null or empty text has no pre-tokens and no tokens; repeated rows stay; an input
column named like an output is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import RANK_FILE, read_ranks
from tidemark.llm.common import PieceCache, map_texts, read_table, worker_store
from tidemark.llm.pretokens import pieces_of, split_texts
from tidemark.runtime import ship_by_value

ship_by_value(__name__)

COST_UNITS = 1 << 20           # to a natural logarithm
COUNT_BITS = 40                # a score is cost << COUNT_BITS | tokens


def piece_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    """Score of one token: -log of 1 / ((rank + 2) * Z) in whole units, and a count of one."""
    z = math.log(math.fsum(1 / (r + 2) for r in ranks.values()))
    return {t: (round(COST_UNITS * (math.log(r + 2) + z)) << COUNT_BITS) + 1
            for t, r in ranks.items()}


class Trie:
    """Forward scores of sorted words, computed once for each prefix."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.scores = piece_scores(ranks)
        self.longest = max(map(len, ranks))

    def counts(self, pieces: list[str]) -> list[int]:
        words = [p.encode() for p in pieces]
        out = [0] * len(words)
        path, previous = [0], b""
        score = self.scores.get
        count = (1 << COUNT_BITS) - 1
        for i in sorted(range(len(words)), key=words.__getitem__):
            word = words[i]
            shared = 0
            for a, b in zip(word, previous):
                if a != b:
                    break
                shared += 1
            del path[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                best = None
                for start in range(end - 1, max(0, end - self.longest) - 1, -1):
                    own = score(word[start:end])
                    if own is not None and (best is None or path[start] + own < best):
                        best = path[start] + own
                path.append(best)
            out[i] = path[-1] & count
            previous = word
        return out


def _trie(path: str) -> PieceCache:
    store = worker_store()
    if ("unigram", path) not in store:
        store["unigram", path] = PieceCache(Trie(read_ranks(path)).counts)
    return store["unigram", path]


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_pretokens`` and ``n_tokens``; ``path`` names the rank file."""

    def run(texts: list[str]) -> dict[str, pa.Array]:
        joined, bounds, firsts = split_texts(texts)
        counts = _trie(path).of(pieces_of(joined, bounds))
        sums = np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])
        return {"n_pretokens": pa.array(np.diff(firsts), pa.int64()),
                "n_tokens": pa.array(sums[firsts[1:]] - sums[firsts[:-1]], pa.int64())}

    return map_texts(docs, text, "n_pretokens long, n_tokens long", run)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path(RANK_FILE))
    return counted.select("doc_id", "n_pretokens", "n_tokens")
