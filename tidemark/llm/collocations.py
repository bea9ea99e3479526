"""Operator 12: phrases whose words occur together more than chance, by prefix-free parsing.

Texts are cut into pieces at punctuation and line ends, and every piece is parsed by its content: a
window of ``OVERLAP`` words whose hash is divisible by ``PERIOD`` ends a chunk and starts the next
one, so neighbouring chunks overlap by that window and equal stretches of text give equal chunks,
wherever they stand.  The parse is kept as a dictionary of distinct chunks with their frequencies.
Phrases of up to ``LONGEST`` words are counted inside the distinct chunks, weighted with those
frequencies; one that lies wholly in the overlap starts in both chunks' texts and is counted for the
later one only, so every occurrence counts exactly once.

Words are counted as texts first, and each gets a key, a 64-bit hash of its language and its bytes.
All words' keys are compared, and should two be equal, the words get other keys; from then on a key
stands for one word, and longer phrases are counted as rows of keys, which are short and of a fixed
width.  The frequent ones get their words back by a join.

Longer phrases are counted only where all their parts are frequent, since a phrase is never more
frequent than a part.  The frequent ones of the length before travel as a bitmap of a fixed size
(``SLOTS`` bits): places may collide, which lets a rare phrase be counted in vain, but a frequent one
always passes, and the counts that are compared are exact.

Each candidate is cut at the place where its two parts explain it best, scored by a squared over the
product of the parts' frequencies in whole numbers, and dropped if a longer candidate takes up
enough of it.  Counts are combined in the task before they are shuffled; no group gathers in a task,
and the ranking of a language sends on at most its first ``TOP`` rows from every task.

Defined results: a null text is empty; a null language is ``und``; letters A-Z are lower-cased;
repeated rows count as often as they stand; ties in score and frequency go by the phrase's bytes; an
empty table gives an empty table.  Very long texts are worked on in parts, cut between pieces.
Only the two columns named are read, so others cannot clash.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import SLICE_BYTES, read_table, text_slices
from tidemark.runtime import materialize, ship_by_value

ship_by_value(__name__)

LONGEST = 3                    # words of a phrase
OVERLAP = LONGEST - 1          # words that neighbouring chunks share
PERIOD = 16                    # one window in so many ends a chunk
LEAST = 10                     # occurrences of a candidate
COVERED = 50                   # per cent of a candidate that a longer one may have at most
TOP = 2000                     # phrases reported a language
SCALE = 1_000_000
SLOTS = 1 << 27                # bits of the bitmap of frequent phrases: 16 MB
PAGE = 1 << 15                 # bits that Spark's bitmap functions hold in a value
HELD_CHUNKS = 300_000          # distinct chunks a task gathers before it passes them on
HELD_PHRASES = 4_000_000       # occurrences of longer phrases likewise
HELD_WORDS = 4_000_000         # occurrences of words likewise
HELD_BYTES = 1 << 26           # and their bytes
ROWS = 1 << 16                 # that a task passes on at a time
SEED = 42                      # of the first keys
HASHED_BYTES = 32              # a longer word is hashed by xxhash
SEPARATORS = ".,;:!?\n\x0b\x0c\r"   # fixed: what ends a piece
END = b"\xff"                  # stands after every piece; no UTF-8 text has that byte
TO_PLAIN = bytes.maketrans(SEPARATORS.encode() + b"\t", END * len(SEPARATORS) + b" ")
ENDING = re.compile(f"[{SEPARATORS}]")
FACTORS = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
SPACE = 32


def parts_of(text: str) -> Iterator[str]:
    """The text in parts of about ``SLICE_BYTES`` characters, cut between pieces."""
    start = 0
    while len(text) - start > 2 * SLICE_BYTES:
        found = ENDING.search(text, start + SLICE_BYTES)
        if not found:
            break
        yield text[start:found.start()]
        start = found.end()
    yield text[start:] if start else text


@dataclass
class Tokens:
    """Words in order, each with one space behind it in ``text``; word i starts at ``at[i]``, and
    ``ended`` tells whether it is the last of its piece.  As a sequence: END after every piece."""

    text: np.ndarray
    at: np.ndarray
    ended: np.ndarray

    def __iter__(self) -> Iterator[bytes]:
        for word, last in zip(self.text.tobytes().split(), self.ended.tolist()):
            yield word
            if last:
                yield END


def tokens_of(texts: list[str]) -> Tokens:
    """All words in order."""
    plain = np.frombuffer("\n".join(texts).encode().lower().translate(TO_PLAIN) + END, np.uint8)
    is_end = plain == END[0]
    inside = ~is_end & (plain != SPACE)
    behind = np.append(False, inside[:-1])
    kept = np.where(inside, plain, SPACE).astype(np.uint8)[inside | behind]
    stops = np.flatnonzero(behind & ~inside)
    ended = np.zeros(len(stops), bool)
    if len(stops):      # an end before the first word falls on the last one, which is one anyway
        ended[np.searchsorted(stops, np.flatnonzero(is_end), "right") - 1] = True
    return Tokens(kept, np.append(0, np.flatnonzero(kept == SPACE) + 1), ended)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(FACTORS[0])
    x ^= x >> np.uint64(32)
    x *= np.uint64(FACTORS[1])
    x ^= x >> np.uint64(29)
    return x


def word_keys(text: np.ndarray, at: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Hashes of the words of ``text``, laid out as in ``Tokens``, with a seed for each of them."""
    length = np.diff(at) - 1
    padded = np.append(text, np.zeros(HASHED_BYTES + 8, np.uint8))
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))    # the bytes from each place on
    masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    start = at[:-1]
    keys = mixed((seeds + length.astype(np.uint64) * np.uint64(FACTORS[1]))
                 ^ (eight[start] & masks[np.minimum(length, 8)]))
    for k in range(8, HASHED_BYTES, 8):
        rest = np.flatnonzero(length > k)
        part = eight[start[rest] + k] & masks[np.minimum(length[rest] - k, 8)]
        keys[rest] = mixed(keys[rest] ^ part)
    for i in np.flatnonzero(length > HASHED_BYTES).tolist():
        keys[i] = xxhash.xxh64_intdigest(text[at[i]:at[i + 1] - 1].tobytes(), int(seeds[i]))
    return keys


def parse(tokens: Tokens) -> tuple[list[bytes], list[bytes]]:
    """Chunks that go on (their last words start the next chunk) and chunks that end their piece."""
    at, ended = tokens.at, tokens.ended
    total = len(ended)
    hashes = word_keys(tokens.text, at, np.full(total, SEED, np.uint64))
    window = np.zeros(total, np.uint64)
    inside = np.ones(total, bool)
    for k in range(OVERLAP):
        window[:total - k] = (window[:total - k] * np.uint64(FACTORS[0])
                              ^ hashes[k:]) * np.uint64(FACTORS[1])
        if k:
            inside[:total - k] &= ~ended[k - 1:total - 1]
            inside[total - k:] = False
    triggers = inside & ((window >> np.uint64(33)) % np.uint64(PERIOD) == 0)
    starts = np.flatnonzero(np.append(True, ended)[:total] | triggers)
    ends = np.flatnonzero(ended) + 1
    stops = ends[np.searchsorted(ends, starts, "right")]
    following = np.append(starts[1:], total)[:len(starts)]
    goes_on = following < stops
    first, last = at[starts], at[np.where(goes_on, following + OVERLAP, stops)] - 1
    text = tokens.text.tobytes()
    return tuple([text[a:b] for a, b in zip(first[which].tolist(), last[which].tolist())]
                 for which in (goes_on, ~goes_on))


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of ``ROWS`` rows, as the reader holds a whole one outside its heap."""
    for start in range(0, batch.num_rows, ROWS):
        yield batch.slice(start, ROWS)


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, chunk, open, n): the distinct chunks of the parse with their frequencies, stored."""
    rows = docs.select(F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"),
                       F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, bool], Counter] = {}

        def batch_of() -> pa.RecordBatch:
            which = np.repeat(np.arange(len(held)), [len(c) for c in held.values()])
            langs, goes_on = zip(*held)
            return pa.RecordBatch.from_pydict({
                "lang": pa.array(langs, pa.string()).take(pa.array(which)),
                "chunk": pa.array([x for c in held.values() for x in c], pa.string()),
                "open": pa.array(goes_on, pa.bool_()).take(pa.array(which)),
                "n": pa.array([x for c in held.values() for x in c.values()], pa.int64())})

        def add(own: str, texts: list[str]) -> None:
            for more, chunks in zip((True, False), parse(tokens_of(texts))):
                held.setdefault((own, more), Counter()).update(chunks)

        for batch in batches:
            for part in text_slices(batch, "text"):
                texts: dict[str, list[str]] = {}
                for own, value in zip(*(part.column(c).to_pylist() for c in ("lang", "text"))):
                    if len(value) > 2 * SLICE_BYTES:
                        for some in parts_of(value):
                            add(own, [some])
                    else:
                        texts.setdefault(own, []).append(value)
                for own, some in texts.items():
                    add(own, some)
                if sum(map(len, held.values())) > HELD_CHUNKS:
                    yield from portions(batch_of())
                    held.clear()
        if held:
            yield from portions(batch_of())

    chunks = rows.mapInArrow(run, "lang string, chunk string, open boolean, n long")
    return materialize(chunks.groupBy("lang", "chunk", "open").agg(F.sum("n").alias("n")),
                       "phrase-chunks")


def slot(words: list[Column]) -> Column:
    """The place in the bitmap of a phrase, given by its words' keys."""
    place = words[0]
    for word in words[1:]:
        place = F.shiftleft(place, 1).bitwiseOR(F.shiftrightunsigned(place, 63)).bitwiseXOR(word)
    return place.bitwiseAND(F.lit(SLOTS - 1).cast("long"))


def turned(words: list[np.ndarray]) -> np.ndarray:
    """The same before the last step."""
    place = words[0]
    for more in words[1:]:
        place = (place << np.uint64(1) | place >> np.uint64(63)) ^ more
    return place


def key_columns(order: int) -> list[str]:
    return [f"key{i}" for i in range(order)]


def bitmap_of(phrases: DataFrame, order: int) -> Broadcast:
    """The frequent phrases' slots as a bitmap of ``SLOTS`` bits, whatever their number."""
    placed = phrases.select(slot([F.col(c) for c in key_columns(order)]).alias("slot"))
    pages = placed.groupBy(F.shiftright("slot", 15).alias("page")).agg(
        F.bitmap_construct_agg(F.col("slot") % PAGE).alias("bits"))
    bits = np.zeros(SLOTS // 8, np.uint8)
    for page in pages.toLocalIterator():    # at most SLOTS / PAGE rows
        start = page["page"] * (PAGE // 8)
        bits[start:start + PAGE // 8] = np.frombuffer(page["bits"], np.uint8)
    return phrases.sparkSession.sparkContext.broadcast(bits.tobytes())


def together(texts: pa.Array, between: str) -> np.ndarray:
    """The bytes of all texts with ``between`` set between them."""
    every = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
    return np.frombuffer(pc.binary_join(every, between)[0].as_buffer(), np.uint8)


def words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of the batch's chunks, laid out as in ``Tokens``, and their number by chunk."""
    chunks = batch.column("chunk")
    size = pc.binary_length(chunks).to_numpy() + 1
    text = np.append(together(chunks, " "), np.uint8(SPACE))
    at = np.append(0, np.flatnonzero(text == SPACE) + 1)
    return text, at, np.diff(np.searchsorted(at, np.append(0, np.cumsum(size))))


def starts_in(batch: pa.RecordBatch, length: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The words that start a phrase of ``order`` words, and how often each such phrase counts."""
    goes_on = batch.column("open").to_numpy(zero_copy_only=False)
    # Of an open chunk the last words belong to the next one.
    last = np.minimum(length - order, np.where(goes_on, length - OVERLAP - 1, length))
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    starts = np.flatnonzero(place <= np.repeat(last, length))
    return starts, np.repeat(batch.column("n").to_numpy(), length)[starts]


def seed_of(lang: str, seed: int) -> int:
    return xxhash.xxh64_intdigest(lang.encode(), seed)


def _word_counts(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """Rows of the dictionary to (lang, phrase, key0, n), combined as far as memory allows."""
    codes: dict[str, int] = {}
    parts: list[pa.Table] = []
    held = size = 0

    def batch_of() -> pa.RecordBatch:
        found = pa.concat_tables(parts).group_by(["lang", "word"], use_threads=False).aggregate(
            [("n", "sum")]).combine_chunks()
        parts.clear()
        which, words = found["lang"].to_numpy(), found["word"].combine_chunks()
        at = np.append(0, np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64))
        seeds = np.array([seed_of(lang, seed) for lang in codes], np.uint64)
        return pa.RecordBatch.from_pydict({
            "lang": pa.array(codes, pa.string()).take(pa.array(which)),
            "phrase": pc.utf8_rtrim(words, " "),
            "key0": word_keys(together(words, ""), at, seeds[which]).view(np.int64),
            "n": found["n_sum"].combine_chunks()})

    for batch in batches:
        text, at, length = words_of(batch)
        langs = batch.column("lang").dictionary_encode()
        own = np.array([codes.setdefault(x, len(codes)) for x in langs.dictionary.to_pylist()],
                       np.int32)[langs.indices.to_numpy()]
        starts, n = starts_in(batch, length, 1)
        words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)),
                                            pa.py_buffer(text))
        parts.append(pa.table({"lang": np.repeat(own, length)[starts], "n": n,
                               "word": words.take(pa.array(starts))}))
        held += len(starts)
        size += len(text)
        if held > HELD_WORDS or size > HELD_BYTES:
            yield from portions(batch_of())
            codes, held, size = {}, 0, 0
    if parts:
        yield from portions(batch_of())


def _phrase_counts(batches: Iterator[pa.RecordBatch], order: int, frequent: Broadcast,
                   seed: int) -> Iterator[pa.RecordBatch]:
    """Rows of the dictionary to (key0, key1, ..., n), combined as far as memory allows."""
    bits = np.frombuffer(frequent.value, np.uint8)
    parts: list[tuple[np.ndarray, ...]] = []    # keys and how often they count
    held = 0

    def batch_of() -> pa.RecordBatch:
        *keys, n = map(np.concatenate, zip(*parts))
        parts.clear()
        sorting = np.argsort(mixed(turned(keys)))
        for i, key in enumerate(keys):
            keys[i] = key[sorting]
        # Different phrases may lie together, so a phrase may get two rows, but each row has only one.
        new = np.ones(len(n), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        starts = np.flatnonzero(new)
        n = np.add.reduceat(n[sorting], starts) if len(n) else n
        return pa.RecordBatch.from_arrays([*(k[starts].view(np.int64) for k in keys), n],
                                          names=[*key_columns(order), "n"])

    for batch in batches:
        text, at, length = words_of(batch)
        langs = batch.column("lang").dictionary_encode()
        seeds = np.array([seed_of(x, seed) for x in langs.dictionary.to_pylist()], np.uint64)
        keys = word_keys(text, at, np.repeat(seeds[langs.indices.to_numpy()], length))
        starts, n = starts_in(batch, length, order)
        # Whether the part of one word less may be frequent that starts at a word.
        total = max(len(keys) - order + 2, 0)
        place = (turned([keys[k:k + total] for k in range(order - 1)])
                 & np.uint64(SLOTS - 1)).astype(np.int64)
        may = bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0
        good = may[starts] & may[starts + 1]
        starts = starts[good]
        parts.append((*(keys[starts + k] for k in range(order)), n[good]))
        held += len(starts)
        if held > HELD_PHRASES:
            yield from portions(batch_of())
            held = 0
    if parts:
        yield from portions(batch_of())


def count_words(chunks: DataFrame) -> tuple[DataFrame, int]:
    """(lang, phrase, key0, n) of all words, stored, and the seed that gives each its own key."""
    for seed in itertools.count(SEED):
        counted = chunks.mapInArrow(lambda batches: _word_counts(batches, seed),
                                    "lang string, phrase string, key0 long, n long")
        words = materialize(counted.groupBy("lang", "phrase", "key0").agg(F.sum("n").alias("n")),
                            "words")
        if words.groupBy("key0").count().where("count > 1").isEmpty():
            return words, seed


def count_phrases(chunks: DataFrame, order: int, frequent: Broadcast, seed: int) -> DataFrame:
    """(key0, key1, ..., n) of all phrases of ``order`` words whose parts may be frequent."""
    keys = key_columns(order)
    counted = chunks.mapInArrow(lambda batches: _phrase_counts(batches, order, frequent, seed),
                                ", ".join(f"{c} long" for c in [*keys, "n"]))
    return counted.groupBy(*keys).agg(F.sum("n").alias("n"))


def spelled(phrases: DataFrame, order: int, words: DataFrame) -> DataFrame:
    """The rows with (lang, phrase) for their keys."""
    keys = key_columns(order)
    for i, key in enumerate(keys):
        known = [F.col("key0").alias(key), F.col("phrase").alias(f"word{i}")]
        phrases = phrases.join(words.select(*known, *(["lang"] if i == 0 else [])), key)
    phrase = F.concat_ws(" ", *[f"word{i}" for i in range(order)])
    return phrases.select("lang", phrase.alias("phrase"), *keys, "n")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
                 covered: int = COVERED, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of every language."""
    chunks = dictionary(docs, text, lang)
    words, seed = count_words(chunks)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    counted = [words.where(F.col("n") >= least)]
    for order in range(2, LONGEST + 1):
        frequent = bitmap_of(counted[-1], order - 1)
        phrases = count_phrases(chunks, order, frequent, seed).where(F.col("n") >= least)
        counted.append(materialize(spelled(phrases, order, counted[0]), f"phrases-{order}"))

    own = F.split("phrase", " ")
    candidates = None
    for order, phrases in enumerate(counted[1:], 2):
        cuts = F.array(*[F.struct(
            F.lit(k).alias("k"), F.array_join(F.slice(own, 1, k), " ").alias("first"),
            F.array_join(F.slice(own, k + 1, order - k), " ").alias("rest"))
            for k in range(1, order)])
        some = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(cuts).alias("cut"))
        candidates = some if candidates is None else candidates.unionByName(some)
    parts = counted[0]
    for phrases in counted[1:-1]:
        parts = parts.select("lang", "phrase", "n").unionByName(phrases.select("lang", "phrase", "n"))
    cut = candidates.select("lang", "phrase", "a", "cut.*")
    for side, count in (("first", "l"), ("rest", "r")):
        cut = cut.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(count)),
                       ["lang", side])
    exact = [f"cast({c} AS decimal(16, 0))" for c in "alr"]
    score = F.expr(f"({SCALE} * {exact[0]} * {exact[0]}) div ({exact[1]} * {exact[2]})")
    scored = cut.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    inside = None
    for order, phrases in enumerate(counted[2:], 3):
        smaller = F.array(*[F.array_join(F.slice(own, start, size), " ")
                            for size in range(2, order) for start in range(1, order - size + 2)])
        some = phrases.select("lang", F.explode(smaller).alias("phrase"), "n")
        inside = some if inside is None else inside.unionByName(some)
    inside = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(
        F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r",
        F.col("total").alias("n"), "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of every language."""
    return collocations(read_table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE = f"""
WITH docs AS (
    SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
           translate(coalesce(text, ''), '{_UPPER}.,;:!?' || chr(11) || chr(12) || chr(13) || chr(9),
                     '{_UPPER.lower()}' || repeat(chr(10), 9) || ' ') AS t
    FROM documents
), pieces AS (
    SELECT d, lang, unnest(string_split(t, chr(10))) AS piece,
           unnest(range(len(string_split(t, chr(10))))) AS p
    FROM docs
), parts AS (
    SELECT d, lang, p, unnest(string_split(piece, ' ')) AS w,
           unnest(range(len(string_split(piece, ' ')))) AS i
    FROM pieces
), words AS (
    SELECT lang, w, lead(w, 1) OVER o AS x, lead(w, 2) OVER o AS y
    FROM parts WHERE w <> '' WINDOW o AS (PARTITION BY d, p ORDER BY i)
), f AS (
    SELECT lang, w AS phrase, 1 AS size, count(*) AS n FROM words GROUP BY lang, w
    UNION ALL
    SELECT lang, w || ' ' || x, 2, count(*) FROM words WHERE x IS NOT NULL GROUP BY lang, w, x
    UNION ALL
    SELECT lang, w || ' ' || x || ' ' || y, 3, count(*) FROM words WHERE y IS NOT NULL
    GROUP BY lang, w, x, y
), often AS (SELECT * FROM f WHERE n >= {LEAST}),
cuts AS (
    SELECT lang, phrase, n AS a, size, 1 AS k, split_part(phrase, ' ', 1) AS first,
           CASE size WHEN 2 THEN split_part(phrase, ' ', 2)
                ELSE split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3) END AS rest
    FROM often WHERE size > 1
    UNION ALL
    SELECT lang, phrase, n, size, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2),
           split_part(phrase, ' ', 3)
    FROM often WHERE size = 3
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.size, c.k, l.n AS l, r.n AS r,
           CAST((CAST({SCALE} AS HUGEINT) * c.a * c.a) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT)
           AS score
    FROM cuts c JOIN often l ON l.lang = c.lang AND l.phrase = c.first
    JOIN often r ON r.lang = c.lang AND r.phrase = c.rest
), least AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth
                   FROM scored) WHERE nth = 1
), inside AS (
    SELECT lang, first AS phrase, a FROM cuts WHERE size = 3 AND k = 2
    UNION ALL
    SELECT lang, rest, a FROM cuts WHERE size = 3 AND k = 1
), longer AS (
    SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase
), ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase)
           AS rank
    FROM least s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
    WHERE g.most IS NULL OR 100 * g.most < {COVERED} * s.a
), totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= {TOP}
"""
