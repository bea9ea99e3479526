"""Operators 3, 5 and 10 against the libraries and plain dynamic programming."""

import hashlib
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from conftest import SMALL
from odd_rows import none, odd  # noqa: F401
from tokenizers import Tokenizer

from tidemark.llm import bpe, packed, pretokens, unigram
from tidemark.llm.common import PieceCache
from tidemark.runtime import shared_folder

RANKS = bpe.read_ranks(public_tokenizers.path(bpe.RANK_FILE))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS,
                            special_tokens={})
ALPHABET = [" ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "a", "Z", "é", "1", "²", "!", ".", "_",
            "　", "\x1c", "\x85", "\xa0", "日", "'t", "\U0001f642", "́"]


def random_texts(n, seed, alphabet=ALPHABET):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(n)]


def split(texts):
    joined, bounds, firsts = pretokens.split_texts(texts)
    pieces, edges = pretokens.pieces_of(joined, bounds), firsts.tolist()
    return [pieces[a:b] for a, b in zip(edges, edges[1:])]


def test_boundaries_equal_the_pattern():
    texts = random_texts(20_000, 1)
    pattern = regex.compile(public_tokenizers.PATTERN)
    assert split(texts) == [pattern.findall(t) for t in texts]


def test_composition_is_associative_and_closed():
    s = pretokens.Scanner()
    r = np.random.default_rng(1)
    a, b, c = r.integers(s.count, size=(3, 1000))
    def join(x, y):
        return s.compose[x * s.count + y]
    assert (join(join(a, b), c) == join(a, join(b, c))).all()


def test_classes_of_all_code_points():
    points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["a" + chr(i) + "1 " + chr(i) for i in points[::7]]
    assert [[k for p in ps for k in bpe.merge_pairs(p.encode(), RANKS)]
            for ps in split(texts)] == LIBRARY.encode_ordinary_batch(texts)


def test_pair_merging_side_by_side_equals_one_by_one():
    words = ["".join(t.split()) or "x" for t in random_texts(3_000, 2)] + ["a" * 31, "ab" * 500]
    got = [np.frombuffer(x, np.uint32).tolist() for x in bpe.Merger(RANKS).ids(words)]
    assert got == [bpe.merge_pairs(w.encode(), RANKS) for w in words]


def test_cache_starts_anew():
    cache = PieceCache(lambda pieces: [len(p) for p in pieces], pieces=3)
    for k in range(10):
        assert cache.of([f"{k}", f"{k}x"]) == [1, 2]
        assert len(cache.values) <= 5


def brute(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return ids, np.array(ids, np.uint32).tobytes()


def test_encode_and_decode(odd, none):
    path = public_tokenizers.path(bpe.RANK_FILE)
    rows = bpe.decode(bpe.encode(odd, path), path).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids, data = brute(r.text)
        assert bytes(r.ids) == data
        assert bytes(r.decoded) == (r.text or "").encode()
        starts = np.frombuffer(r.offsets, np.uint32).tolist()
        lengths = [len(LIBRARY.decode_single_token_bytes(i)) for i in ids]
        assert starts == (np.cumsum(lengths) - lengths).tolist() if ids else starts == []
        assert r.lang is None or r.host == "x"
    assert bpe.decode(bpe.encode(none, path), path).collect() == []


def test_query_digests(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = bpe.op3_byte_bpe(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids, data = brute(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(data).hexdigest(),
            hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_parts_encode_like_whole_texts():
    texts = random_texts(20_000, 3, ALPHABET + ["<|endoftext|>", ",", ")", "Ⅷ"])
    path = public_tokenizers.path(packed.TOKENIZER_FILE)
    library = Tokenizer.from_file(path)
    got = [np.frombuffer(x, np.uint16).tolist() for x in packed.TextEncoder(path).ids(texts)]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_packed_files(spark, odd, none):
    path = public_tokenizers.path(packed.TOKENIZER_FILE)
    library = Tokenizer.from_file(path)
    folder = f"{shared_folder(spark)}/packed-test-{uuid.uuid4().hex}"
    manifest = packed.write_packed(odd, folder, path)
    rows = sorted(packed.read_documents(manifest, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 2, 3, 4, 5, 6, 7]
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    at = 0
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids + [packed.END_ID]
        assert np.frombuffer(r.ids, np.uint32).tolist() == ids
        assert (r.start, r.n_tokens) == (at, len(ids))
        at += len(ids)
    empty = packed.write_packed(none, folder, path)
    assert packed.read_documents(empty, folder).collect() == []


def test_sequences_are_read_without_copies(spark, odd):
    folder = f"{shared_folder(spark)}/packed-test-{uuid.uuid4().hex}"
    manifest = packed.write_packed(odd, folder, public_tokenizers.path(packed.TOKENIZER_FILE))
    for row in manifest.collect():
        reader = packed.open_file(folder, row.file)
        before = pa.total_allocated_bytes()
        ids, mask = packed.sequence(reader, 0)
        assert len(ids) == len(mask) == packed.SEQUENCE and not ids.flags.owndata
        assert pa.total_allocated_bytes() - before < ids.nbytes
        used = sum(packed.sequence(reader, k)[1].sum()
                   for k in range(-(-row.n_tokens // packed.SEQUENCE)))
        assert used == row.n_tokens


def test_packed_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    library = Tokenizer.from_file(public_tokenizers.path(packed.TOKENIZER_FILE))
    rows = {r.doc_id: r for r in packed.op5_packed_tokens(spark, SMALL).collect()}
    at = 0
    for d in docs:
        ids = library.encode(d.text, add_special_tokens=False).ids + [packed.END_ID]
        r = rows[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (
            at, len(ids), zlib.crc32(np.array(ids, np.uint32).tobytes()))
        at += len(ids)


def plain_count(piece, scores, longest):
    best = [0] + [None] * len(piece)
    for end in range(1, len(piece) + 1):
        best[end] = min(best[s] + scores[piece[s:end]]
                        for s in range(max(0, end - longest), end) if piece[s:end] in scores)
    return best[-1] & (1 << unigram.COUNT_BITS) - 1


def test_unigram_counts(odd, none):
    scores = unigram.piece_scores(RANKS)
    longest = max(map(len, RANKS))
    path = public_tokenizers.path(bpe.RANK_FILE)
    for r in unigram.count_tokens(odd, path).collect():
        pieces = regex.findall(public_tokenizers.PATTERN, r.text or "")
        assert r.n_pretokens == len(pieces)
        assert r.n_tokens == sum(plain_count(p.encode(), scores, longest) for p in pieces)
    assert unigram.count_tokens(none, path).collect() == []


@pytest.mark.parametrize("words", [["a"], ["abc", "ab", "abcd", "b"], random_texts(500, 4)])
def test_trie_shares_scores(words):
    words = [w for w in dict.fromkeys(words) if w]
    scores = unigram.piece_scores(RANKS)
    assert unigram.Trie(RANKS).counts(words) == [
        plain_count(w.encode(), scores, max(map(len, RANKS))) for w in words]
