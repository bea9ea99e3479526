"""Operator 11: repair of the turn order of conversations by generalised LR parsing.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: perhaps a system turn, then
pairs of user and assistant.  As an LR grammar::

    Conversation -> (empty) | Pairs        Pairs -> Lead u a | Pairs u a        Lead -> (empty) | s

Its parser's stack tops are START, LEAD (``s`` shifted), OPEN (``u`` shifted) and PAIRS (``ua``
reduced).  Every turn may be kept, made a user's or an assistant's turn, or deleted, and empty turns
of either may be inserted anywhere, each at a cost.  All these actions are followed at once on a
graph-structured stack: after every turn, stacks with equal tops are merged into the one with the
least (cost, audit), where the audit is the string of the actions' initials.  That merge is exact:
after a turn every audit ends in that turn's own letter, so of two different audits neither is a
prefix of the other, and what follows cannot change their order.  Tops that cost more than
``SLACK`` above the best are cut off, because the best one can imitate whatever they do for less.

Which tops a turn leads to depends only on the differences of cost and the order of the audits, so
those steps are computed once and looked up afterwards; a turn costs one look-up and keeps one
reference to its step, from which the audit is read backwards at the end.

A conversation of any length passes as a sorted stream: the first pass reads narrow rows and gives
the audits, the second reads the texts and hashes the repaired conversation piece by piece, since the
hash is sequential.  Neither holds a conversation's texts, and Spark's sort spills.  Repeated turns
are found by (conversation, role, text), so one conversation does not gather for that.

Defined results: a null role or text is one space, so a null text is blank and a null role is no
known role; a null turn comes first; turns of equal number are ordered by role and text; a null
conversation id is a conversation of its own; repeated rows are duplicates; roles count by their
first character, and an empty one has none; an empty table gives an empty table.  Other columns are
not read, so their names cannot clash; very long texts are hashed row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import read_table
from tidemark.runtime import materialize, ship_by_value

ship_by_value(__name__)

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
START, LEAD, OPEN, PAIRS = range(4)
SHIFT = {(START, "s"): LEAD, (START, "u"): OPEN, (LEAD, "u"): OPEN, (PAIRS, "u"): OPEN,
         (OPEN, "a"): PAIRS}
ACCEPTING = START, PAIRS
# From any top the work of any other can be had for two inserts and one deletion more.
SLACK = 2 * INSERT + DELETE
FIRST = ((START, 0, 0),)       # (top, cost above the least, place of its audit among the tops')
WHITE = " \t\n\x0b\f\r"        # fixed: the white space of the contract
LEGAL = "su", "ua", "au"       # fixed: what may follow what
NAMES = {"u": "user", "a": "assistant"}
FAULTS = "blank", "duplicate", "truncated"
SUMMARY = ("conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, "
           "cost long, audit string")


def wanted(top: int) -> str:
    """The role that an inserted or changed turn gets at this stack top."""
    return "a" if top == OPEN else "u"


def inserted(top: int) -> list[tuple[int, str]]:
    """Stack tops that inserts lead to, with their letters; more of them only lead around."""
    found, letters = [(top, "")], ""
    while SHIFT[top, wanted(top)] not in [t for t, _ in found]:
        top, letters = SHIFT[top, wanted(top)], letters + "I"
        found.append((top, letters))
    return found


def step(tops: tuple, initial: str, fault: int) -> tuple[tuple, int, dict]:
    """The tops after a turn, what the least cost rose by, and each top's (top before, letters)."""
    more = TRUNCATED if fault == 3 else 0
    best: dict[int, tuple] = {}
    for before, cost, place in tops:
        for top, letters in inserted(before):
            ways = [("D", top, DELETE)]
            if fault not in (1, 2):
                ways.append(("R", SHIFT[top, wanted(top)], REROLE + more))
                if (top, initial) in SHIFT:
                    ways.append(("K", SHIFT[top, initial], more))
            for letter, after, price in ways:
                way = (cost + price + INSERT * len(letters), place, letters + letter, before)
                if after not in best or way < best[after]:
                    best[after] = way
    least = min(way[0] for way in best.values())
    kept = {top: way for top, way in best.items() if way[0] <= least + SLACK}
    order = {way[1:3]: i for i, way in enumerate(sorted(kept.values(), key=lambda w: w[1:3]))}
    after = tuple(sorted((top, way[0] - least, order[way[1:3]]) for top, way in kept.items()))
    return after, least, {top: (way[3], way[2]) for top, way in kept.items()}


class Parser:
    """The stack of one conversation at a time; steps are shared by all of them."""

    def __init__(self) -> None:
        self.known: dict[tuple, tuple] = {}
        self.start()

    def start(self) -> None:
        self.tops, self.cost, self.backward = FIRST, 0, []

    def read(self, initial: str, fault: int) -> None:
        key = self.tops, initial if initial in "sua" else "", fault
        if key not in self.known:
            self.known[key] = step(*key)
        self.tops, rise, back = self.known[key]
        self.cost += rise
        self.backward.append(back)

    def end(self) -> tuple[int, str]:
        """Least cost and its audit."""
        ways = [(cost + INSERT * len(letters), place, letters, before)
                for before, cost, place in self.tops
                for top, letters in inserted(before) if top in ACCEPTING]
        cost, _, letters, top = min(ways)
        parts = [letters]
        for back in reversed(self.backward):
            top, letters = back[top]
            parts.append(letters)
        return self.cost + cost, "".join(reversed(parts))


def _summaries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn to one row a conversation."""
    parser = Parser()
    now, seen = None, False
    done: list[tuple] = []

    def close() -> tuple:
        cost, audit = parser.end()
        gaps = high - low + 1 - turns if turns else 0
        return (now, gaps, *faults[1:], illegal, cost, audit)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for conv, present, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if not seen or conv != now:
                if seen:
                    done.append(close())
                    if sum(len(r[-1]) for r in done[-64:]) > 1 << 20 or len(done) >= 4096:
                        yield batch_of(done)
                        done = []
                now, seen = conv, True
                parser.start()
                low = high = last = None
                faults, turns, illegal = [0, 0, 0, 0], 0, 0
            if not present:
                continue
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
            illegal += last is not None and last + initial not in LEGAL
            last = initial
            faults[fault] += 1
            parser.read(initial, fault)
    if seen:
        yield batch_of([*done, close()])


def repaired_lines(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[str]:
    """``role:text`` of each turn of the repaired conversation."""
    top = START
    for letter in audit:
        if letter == "I":
            role, text = NAMES[wanted(top)], ""
        else:
            role, text = next(turns)
            if letter == "D":
                continue
            if letter == "R":
                role = NAMES[wanted(top)]
        top = SHIFT[top, role[0]]
        yield f"{role}:{text}"


def _hashes(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, its audit before its turns, to one hash a conversation."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield tuple(c[i].as_py() for c in batch.columns)

    stream = rows()
    row = next(stream, None)
    out: list[tuple] = []
    while row:
        conv, audit, row = row[0], row[1], next(stream, None)

        def turns() -> Iterator[tuple[str, str]]:
            nonlocal row
            while row and row[1] is None:
                one = row[2:4]
                row = next(stream, None)
                yield one

        own, digest, first = turns(), hashlib.sha256(), True
        for line in repaired_lines(audit, own):
            digest.update(("" if first else "\n").encode() + line.encode())
            first = False
        out.append((conv, digest.hexdigest()))
        if len(out) >= 4096:
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(zip(*out), schema)], schema=schema)


def faulty_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str,
                 present: Column) -> DataFrame:
    """(conv, present, turn, role, text, initial, fault): fault 0 none, else a place in FAULTS."""
    rows = turns.select(
        F.col(f"`{conv}`").alias("conv"), present.alias("present"),
        F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(f"`{text}`"), F.lit(" ")).alias("text"))
    same = Window.partitionBy("conv", "role", "text", "present").orderBy(F.asc_nulls_first("turn"))
    shown = F.rtrim("text", F.lit(WHITE))
    fault = (F.when(shown == "", 1).when(F.row_number().over(same) > 1, 2)
             .when(~F.substring(shown, -1, 1).isin(".", "!", "?"), 3).otherwise(0))
    return rows.select("*", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", present: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Summaries of all conversations (counts of faults, cost and audit) and their stored turns.

    Rows for which ``present`` is false only name a conversation.
    """
    rows = materialize(faulty_turns(turns, conv, turn, role, text, F.lit(True) if present is None
                                    else present), "turns")
    kind = turns.schema[conv].dataType.simpleString()
    schema = rows.sparkSession.createDataFrame([], SUMMARY.format(kind=kind)).schema
    arrow = pa.schema([(f.name, t) for f, t in zip(schema, _arrow_kinds(turns, conv))])
    dealt = rows.repartition("conv").sortWithinPartitions(*_in_order())
    told = dealt.select("conv", "present", "turn", "initial", "fault").mapInArrow(
        lambda batches: _summaries(batches, arrow), schema)
    return told, rows


def repaired_hashes(summaries: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) from the two tables of ``repair``."""
    kind = summaries.schema["conv_id"].dataType.simpleString()
    audits = summaries.select(F.col("conv_id").alias("conv"), "audit", *[
        F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"),
                                                  ("text", "string"))])
    kept = rows.where("present").select("conv", F.lit(None).cast("string").alias("audit"), "turn",
                                        "role", "text")
    both = audits.unionByName(kept).repartition("conv").sortWithinPartitions(
        F.asc_nulls_first("conv"), F.col("audit").isNull(), *_in_order()[1:])
    arrow = pa.schema([("conv_id", _arrow_kinds(rows, "conv")[0]), ("repaired_sha256", pa.string())])
    return both.select("conv", "audit", "role", "text").mapInArrow(
        lambda batches: _hashes(batches, arrow), f"conv_id {kind}, repaired_sha256 string")


def _in_order() -> list[Column]:
    return [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")]


def _arrow_kinds(df: DataFrame, conv: str) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(df.schema[conv].dataType), *[pa.int64()] * 6, pa.string()]


def damage(turns: DataFrame) -> DataFrame:
    """The contract's damage: every twentieth turn is dropped (``present`` false), emptied, robbed of
    its final marks, repeated or made a user's."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":")
                     for c in ("conv_id", "", "turn")])
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"),
                        F.pmod(F.crc32(key), F.lit(20)).alias("way"))
    text = (F.when(F.col("way") == 1, "").when(
        F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("way") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                       (F.col("way") != 0).alias("present"), F.explode(times).alias("copy"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the repaired text's hash of every damaged conversation."""
    turns = damage(read_table(spark, sf_dir, "conversations"))
    summaries, rows = repair(turns, present=F.col("present"))
    summaries = materialize(summaries, "conversation-summaries")
    hashes = repaired_hashes(summaries, rows).withColumnRenamed("conv_id", "own")
    return summaries.join(hashes, F.col("conv_id").eqNullSafe(F.col("own"))).drop("own")
