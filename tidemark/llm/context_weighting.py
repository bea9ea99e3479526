"""Operator 13: scores of texts by context-tree weighting over bytes.

A text is read as the bytes of its lower-cased words, one space between them, and a line feed as its
end.  A byte is eight binary decisions, the highest bit first; a decision's node is the bits already
known (``prefix``, 1 to 255) with the last d bytes before it, for d from 0 to ``DEPTH``.  Each node
estimates its bit by Krichevsky and Trofimov, (count + 1/2) / (n + 1), and every inner node weighs
that estimate against what its longer contexts say::

    weighted(node) = 1/2 * estimated(node) + 1/2 * product of weighted(longer contexts of it)

Counted over the training texts, this gives each node the weight with which a prediction stops there;
a bit's probability is the mixture of the estimates along its contexts, from the shortest to the
longest one seen in training.  A longer context that was never seen has nothing to say: its share
stays with the last one seen.

All of it is joins and aggregations of runs of ``DEPTH`` + 1 bytes.  Texts fall into blocks of
bounded size; a block's distinct runs and words are counted in the task and written once, combined
over blocks to the corpus' counts, and every distinct run of the corpus is scored once.  Then each
block gets back the values of its own runs and words and adds them up along its texts, so no task
ever holds the model, and nothing of it passes the driver.  Rows a frequent run has are one a block.

The base beside it is the add-one unigram model of the words, with the end counted as one of them.

Defined results: a null text is empty and scores its end alone; a null key is not held out; repeated
rows are scored, and learnt from, as often as they stand; without training texts every bit has
probability 1/2; an empty table gives an empty table.  A text is never cut, and a very long one is
worked on in parts of ``PART`` bytes.  Input columns with a result's name are replaced.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import brought_back, read_table, set_aside
from tidemark.runtime import materialize, shared_folder, ship_by_value

ship_by_value(__name__)

DEPTH = 4                      # bytes of the longest context; with its byte, at most 7 fit a long
BLOCK = 32 << 20               # bytes of text a block takes before the next one begins
PART = 1 << 20                 # bytes looked up at a time
END = b"\n"
FOLDS, HELD = 7, 2             # crc32(key) mod FOLDS of held-out texts
VALUES = "run long, word binary, n long"
RESULTS = ("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
           "score double, bits_per_byte double")


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-cased words and the end."""
    return [*(text or "").encode().lower().split(), END]


def stream_of(tokens: list[bytes]) -> bytes:
    """The bytes that are predicted."""
    return b" ".join(tokens[:-1]) + END


def runs_of(stream: bytes, before: bytes) -> np.ndarray:
    """Each byte below its context of ``DEPTH`` bytes, as one number."""
    data = np.frombuffer(before + stream, np.uint8).astype(np.int64)
    run = data[:len(stream)]
    for k in range(1, DEPTH + 1):
        run = run << 8 | data[k:k + len(stream)]
    return run


def parts_of(stream: bytes) -> Iterator[np.ndarray]:
    """The runs of a stream of any length, in parts."""
    for i in range(0, len(stream), PART):
        yield runs_of(stream[i:i + PART], stream[i - DEPTH:i] if i else END * DEPTH)


class _Counts:
    """How often the runs and words of a block's training texts stand there, and which others do."""

    def __init__(self) -> None:
        self.words: tuple[Counter, Counter] = Counter(), Counter()
        self.runs: list[list[np.ndarray]] = [[], []]
        self.waiting: list[list[bytes]] = [[], []]
        self.bytes = [0, 0]
        self.size = 0

    def add(self, text: str | None, learn: bool) -> None:
        tokens = tokens_of(text)
        self.words[learn].update(tokens)
        stream = stream_of(tokens)
        self.size += len(stream)
        if len(stream) > PART:
            self.runs[learn] += [_counted(run) for run in parts_of(stream)]
            return
        self.waiting[learn].append(END * DEPTH + stream)
        self.bytes[learn] += len(stream)
        if self.bytes[learn] > PART:
            self.flush(learn)

    def flush(self, learn: bool) -> None:
        """Count the waiting streams together; the padding between them is no run."""
        if self.waiting[learn]:
            data = b"".join(self.waiting[learn])
            run = runs_of(data[DEPTH:], data[:DEPTH])
            lengths = np.array([len(s) for s in self.waiting[learn]])
            starts = np.cumsum(lengths) - lengths - DEPTH
            own = np.ones(len(run), bool)
            for k in range(DEPTH):
                own[starts[1:] + k] = False
            self.runs[learn].append(_counted(run[own]))
            self.waiting[learn], self.bytes[learn] = [], 0
        if len(self.runs[learn]) > 8:
            self.runs[learn] = [_merged(self.runs[learn])]

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        """Every distinct run and word once, n counting training texts only."""
        for learn in (False, True):
            self.flush(learn)
        other, learnt = map(_merged, self.runs)
        run, n = _merged([(other[0], other[1] * 0), learnt])
        yield _rows(block, run, [None] * len(run), n)
        words = dict.fromkeys(self.words[False], 0) | self.words[True]
        yield _rows(block, None, list(words), list(words.values()))


def _counted(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    run = np.sort(run)
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1])[:len(run)])
    return run[starts], np.diff(np.append(starts, len(run)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    run = np.concatenate([r for r, _ in parts] or [np.zeros(0, np.int64)])
    n = np.concatenate([c for _, c in parts] or [np.zeros(0, np.int64)])
    order = np.argsort(run, kind="stable")
    run, n = run[order], n[order]
    starts = np.flatnonzero(np.append(True, run[1:] != run[:-1])[:len(run)])
    return run[starts], np.add.reduceat(n, starts) if len(run) else n


def _rows(block: int, run: np.ndarray | None, words: list, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(words), block)), pa.nulls(len(words), pa.int64()) if run is None
         else pa.array(run), pa.array(words, pa.binary()), pa.array(n, pa.int64())],
        names=["block", "run", "word", "n"])


def in_blocks(docs: DataFrame, text: str, held_out: Column) -> DataFrame:
    """``docs`` stored with ``held`` and ``block``, which holds about ``BLOCK`` bytes of text."""
    rows = docs.withColumn("held", held_out).withColumn("block", F.lit(0).cast("long"))
    kept = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy()
            block = first + (size + np.cumsum(lengths) - lengths) // BLOCK
            size += int(lengths.sum())
            columns = [*(batch.column(c) for c in kept), pa.array(block, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "block"])

    path = f"{shared_folder(docs.sparkSession)}/blocks-{uuid.uuid4().hex}"
    stored = rows.mapInArrow(run, rows.schema)
    stored.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path)


def block_counts(stored: DataFrame, text: str) -> DataFrame:
    """(block, run or word, n): what stands in a block, and how often in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None
        for batch in batches:
            for block, held, value in zip(*(batch.column(c).to_pylist()
                                            for c in ("block", "held", text))):
                if block != now:
                    if counts:
                        yield from counts.rows(now)
                    now, counts = block, _Counts()
                counts.add(value, not held)
        if counts:
            yield from counts.rows(now)

    rows = stored.select("block", "held", F.col(f"`{text}`")).mapInArrow(run, f"block long, {VALUES}")
    return materialize(rows, "block-counts")


def log_gamma(x: Column) -> Column:
    """ln of the gamma function from Stirling's series eight places higher up."""
    z = x + 8
    series = (1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5) - 1 / (1680 * z ** 7))
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + series - F.ln(product)


def log_estimated(zeros: Column, ones: Column) -> Column:
    """ln of what Krichevsky's and Trofimov's estimator gives a sequence with these counts."""
    a, b = zeros.cast("double"), ones.cast("double")
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1) - 1.1447298858494002


def nodes(runs: DataFrame, depth: int) -> list[DataFrame]:
    """For every depth the nodes (ctx, prefix) with kt, the probability of a one; seen; and stop, the
    weight with which a prediction ends there."""
    levels: list[DataFrame] = []
    both = [F.col("zeros"), F.col("ones")]
    level = runs.groupBy("ctx", "prefix").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("ones"))
    level = level.select("*", log_estimated(*both).alias("weighted"), F.lit(1.0).alias("stop"))
    for d in range(depth, -1, -1):
        if d < depth:
            level = level.groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1).cast("long"))
                                  .alias("ctx"), "prefix").agg(
                F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"),
                F.sum("weighted").alias("longer"))
            level = level.withColumn("own", log_estimated(*both))
            gap = F.col("longer") - F.col("own")
            level = level.select(
                "ctx", "prefix", "zeros", "ones",
                (F.greatest("own", "longer") + F.log1p(F.exp(-F.abs(gap))) - F.ln(F.lit(2.0)))
                .alias("weighted"), (1 / (1 + F.exp(F.least(gap, F.lit(700.0))))).alias("stop"))
        level = materialize(level, f"context-nodes-{d}")
        n = F.col("zeros") + F.col("ones")
        levels.append(level.select("ctx", "prefix", ((F.col("ones") + 0.5) / (n + 1)).alias("kt"),
                                   (n > 0).alias("seen"), "stop"))
    return levels[::-1]


def run_scores(counts: DataFrame) -> DataFrame:
    """(run, value): log10 of the probability of each run's last byte after the others."""
    distinct = materialize(counts.where("run IS NOT NULL").groupBy("run").agg(
        F.sum("n").alias("n")), "runs")
    byte = F.col("run").bitwiseAND(F.lit(255).cast("long"))
    bits = F.array(*[F.struct(
        F.shiftright(byte, 8 - k).bitwiseOR(F.lit(1 << k).cast("long")).cast("int").alias("prefix"),
        F.shiftright(byte, 7 - k).bitwiseAND(F.lit(1).cast("long")).cast("int").alias("bit"))
        for k in range(8)])
    runs = distinct.select("run", F.shiftright("run", 8).alias("ctx"), "n",
                           F.explode(bits).alias("d")).select("run", "ctx", "n", "d.*")
    levels = nodes(runs, DEPTH)
    # Mixed so far, weight left, and the probability if this context is the last one seen.
    told = levels[0].select("ctx", "prefix", (F.col("stop") * F.col("kt")).alias("mixed"),
                            (1 - F.col("stop")).alias("left"), F.col("kt").alias("one"))
    for d, level in enumerate(levels[1:], 1):
        before = told.select(F.col("ctx").alias("shorter"), "prefix", "mixed", "left", "one")
        short = F.lit((1 << 8 * (d - 1)) - 1).cast("long")
        both = level.withColumn("shorter", F.col("ctx").bitwiseAND(short)).join(
            before, ["shorter", "prefix"])
        seen = F.col("seen")
        told = both.select(
            "ctx", "prefix",
            F.when(seen, F.col("mixed") + F.col("left") * F.col("stop") * F.col("kt"))
            .otherwise(F.col("one")).alias("mixed"),
            F.when(seen, F.col("left") * (1 - F.col("stop"))).otherwise(0.0).alias("left"),
            F.when(seen, F.col("mixed") + F.col("left") * F.col("kt"))
            .otherwise(F.col("one")).alias("one"))
    chosen = F.when(F.col("bit") == 1, F.col("one")).otherwise(1 - F.col("one"))
    return runs.join(told.select("ctx", "prefix", "one"), ["ctx", "prefix"]).groupBy("run").agg(
        F.sum(F.log10(chosen)).alias("value"))


def _scored(rows: pa.Table, values: pa.Table, text: str, kept: list[str], schema: pa.Schema,
            total: int, size: int) -> pa.Table:
    """One block's texts with the sums of their runs' and words' values."""
    is_run = values.column("word").is_null().to_numpy()
    value = values.column("value").to_numpy()
    run = values.column("run").filter(pa.array(is_run)).to_numpy()
    order = np.argsort(run)
    run, of_run = run[order], value[is_run][order]
    words = values.column("word").filter(pa.array(~is_run)).to_pylist()
    of_word = dict(zip(words, value[~is_run].tolist()))
    rare = math.log10(1.5 / size)          # between the values of no and of one occurrence
    known = {w for w, own in of_word.items() if own > rare}
    out: list[list] = [[] for _ in range(5)]
    for piece in rows.column(text).to_pylist():
        tokens = tokens_of(piece)
        stream = stream_of(tokens)
        score = sum(float(of_run[np.searchsorted(run, part)].sum()) for part in parts_of(stream))
        for column, x in zip(out, (
                len(tokens), sum(map(known.__contains__, tokens)),
                math.fsum(map(of_word.__getitem__, tokens)), score,
                -score / math.log10(2) / len(stream))):
            column.append(x)
    made = [rows.column("held"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
            pa.array(np.full(len(out[0]), total), pa.int64()), pa.array(out[2], pa.float64()),
            pa.array(out[3], pa.float64()), pa.array(out[4], pa.float64())]
    return pa.Table.from_arrays([*(rows.column(c) for c in kept), *made], schema=schema)


def score_texts(docs: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """``docs`` with the columns of RESULTS, by models of the texts that are not ``held_out``."""
    made = docs.sparkSession.createDataFrame([], RESULTS).schema
    rows, names = set_aside(docs.withColumn("held out?", held_out))
    flag = names.pop("held out?")
    stored = in_blocks(rows, names[text], F.coalesce(F.col(f"`{flag}`"), F.lit(False)))
    counts = block_counts(stored, names[text])
    words = counts.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c"))
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"),
                      F.count_if(F.col("c") > 0).alias("kinds")).first()
    size = total["total"] + total["kinds"] + 1
    everywhere = F.sum("n").over(Window.partitionBy("word"))
    of_words = counts.where("word IS NOT NULL").select("block", "word", everywhere.alias("c")).select(
        "block", F.lit(None).cast("long").alias("run"), "word",
        F.log10((F.col("c") + 1) / F.lit(size).cast("double")).alias("value"))
    of_runs = counts.where("run IS NOT NULL").select("block", "run").join(
        run_scores(counts), "run").select(
        "block", "run", F.lit(None).cast("binary").alias("word"), "value")
    values = of_runs.unionByName(of_words)
    taken = {f.name.lower() for f in made}
    kept = {c: w for c, w in names.items() if c.lower() not in taken}
    # Working names do not clash with the results'.
    schema = type(made)([stored.schema[w] for w in kept.values()] + list(made))
    arrow = to_arrow_schema(schema)
    scored = stored.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(
        lambda left, right: _scored(left, right, names[text], list(kept.values()), arrow,
                                    total["total"], size), schema)
    results = {f.name: f.name for f in made}
    return brought_back(scored, kept | results)


def op13_context_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by both models."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD
    return score_texts(docs, held).drop("text")
