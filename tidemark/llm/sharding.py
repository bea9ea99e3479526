"""Operator 2: shards by balanced label propagation.

Documents with equal texts are linked.  All rows start in shards of equal size.  In each round every
linked document learns, by joins, which shard holds most of its group, and asks to move there; a
group larger than a shard has as many target shards as it fills, and smaller groups leave those to
it.  Quotas keep the law: a shard takes
exactly as many rows as it gives, first in exchange for rows that want to go the other way, then
for rows without links, which may lie anywhere.  So counts stay at most one apart after every
round while links between shards, the cut edges, vanish.  Rounds end when nothing can move.

Quotas are made on the driver from at most shards x shards counts.  Numbers without gaps come from
hashed buckets of about ``BUCKET_ROWS`` rows and sums over smaller buckets, never from one task.

Defined results: a null text has no bytes and no links; an empty text is linked with other empty
ones; repeated rows are rows of their own; an empty table gives an empty table.  Only the key and
the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import read_table
from tidemark.runtime import materialize

SHARDS = 24
ROUNDS = 12
BUCKET_ROWS = 20_000
FREE, STAYS = -1, -2           # lanes of rows without links, and of rows that are where they should


def numbered(rows: DataFrame, by: list[str], buckets: int, name: str) -> DataFrame:
    """``rows`` (with ``row_id``) with a gapless number from 0 within each ``by``."""
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.lit(buckets)))
    counts = rows.groupBy(*by, "bucket").agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))
                            .alias("offset"))
    place = F.row_number().over(Window.partitionBy(*by, "bucket").orderBy("row_id"))
    return rows.withColumn("place", place).join(offsets, [*by, "bucket"]).withColumn(
        name, F.col("offset") + F.col("place") - 1).drop("bucket", "place", "offset")


def quotas(wants: dict[tuple[int, int], int],
           free: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """Moves that leave every shard's count as it is: (from, lane, first, end, to), for the rows
    of a lane numbered ``first`` up to ``end``."""
    moves = {pair: min(n, wants.get(pair[::-1], 0)) for pair, n in wants.items()}
    left, given = dict(free), {}
    for (a, b), n in sorted(wants.items(), key=lambda x: (moves[x[0]] - x[1], x[0])):
        swap = min(n - moves[a, b], left.get(b, 0))
        if swap:
            moves[a, b] += swap
            left[b] -= swap
            given[b, a] = given.get((b, a), 0) + swap
    out = [(a, b, 0, n, b) for (a, b), n in moves.items() if n]
    used: dict[int, int] = {}
    for (b, a), n in given.items():
        first = used.get(b, 0)
        out.append((b, FREE, first, first + n, a))
        used[b] = first + n
    return out


Group = tuple[int, int]


def _large_groups(state: DataFrame, capacity: int) -> dict[Group, dict[int, int]]:
    """Rows by shard of each group that fills a shard or more.

    There are at most as many such groups as shards, so at most shards x shards counts come here.
    """
    pieces = state.where("linked").groupBy("g1", "g2", "shard").agg(F.count("*").alias("n"))
    large = pieces.groupBy("g1", "g2").agg(F.sum("n").alias("size")).where(
        F.col("size") >= capacity)
    counts: dict[Group, dict[int, int]] = {}
    for r in pieces.join(large, ["g1", "g2"]).collect():
        counts.setdefault((r["g1"], r["g2"]), {})[r["shard"]] = r["n"]
    return counts


def claims(counts: dict[Group, dict[int, int]], shards: int, capacity: int
           ) -> dict[Group, list[int]]:
    """The target shards of each large group: those that hold most of it and no other one fills."""
    out, full = {}, set()
    for group, held in sorted(counts.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        size = sum(held.values())
        order = sorted(set(range(shards)) - full, key=lambda s: (-held.get(s, 0), s))
        out[group] = order[:-(-size // capacity)]
        full.update(order[:size // capacity])
    return out


def _wishes(state: DataFrame, claimed: dict[Group, list[int]],
            counts: dict[Group, dict[int, int]], capacity: int, shards: int) -> DataFrame:
    """The rows with their ``lane``: the shard they want, or ``FREE`` or ``STAYS``.

    A group wants the shard that holds most of it, among those that no large group fills; a large
    group's rows want those of its shards that have room for more of it.
    """
    spark = state.sparkSession
    taken = sorted({s for targets in claimed.values() for s in targets})
    rest = sorted(set(range(shards)) - set(taken)) or list(range(shards))
    allowed = F.array(*map(F.lit, rest))
    pieces = state.where("linked").groupBy("g1", "g2", "shard").agg(F.count("*").alias("n"))
    best = F.max_by("shard", F.when(F.array_contains(allowed, F.col("shard")),
                                    F.struct("n", -F.col("shard"))))
    own = F.element_at(allowed, F.pmod(F.xxhash64("g1", "g2"), F.lit(len(rest))).cast("int") + 1)
    targets = pieces.groupBy("g1", "g2").agg(best.alias("best"))
    targets = targets.select("g1", "g2", F.array(F.coalesce("best", own)).alias("usual"))
    room = {g: [s for s in t if counts[g].get(s, 0) < capacity] for g, t in claimed.items()}
    large = spark.createDataFrame([(*g, t, room[g]) for g, t in claimed.items()],
                                  "g1 long, g2 long, claimed array<int>, room array<int>")
    # At most one row a shard.
    targets = targets.join(F.broadcast(large), ["g1", "g2"], "left").select(
        "g1", "g2", F.coalesce("claimed", "usual").alias("targets"),
        F.coalesce("room", "usual").alias("room"))
    joined = state.join(targets, ["g1", "g2"], "left")
    pick = F.try_mod(F.xxhash64("row_id", F.lit(1)).bitwiseAND(F.lit((1 << 62) - 1)), F.size("room"))
    lane = (F.when(~F.col("linked"), FREE)
            .when(F.array_contains("targets", F.col("shard")) | (F.size("room") == 0), STAYS)
            .otherwise(F.get("room", pick.cast("int"))))
    return joined.select(*state.columns, lane.cast("int").alias("lane"))


def propagate(state: DataFrame, shards: int, rounds: int, buckets: int, rows: int) -> DataFrame:
    """Rounds of moves over (row_id, g1, g2, linked, shard), each stored."""
    spark = state.sparkSession
    capacity = max(1, rows // shards)
    counts = _large_groups(state, capacity)
    claimed = claims(counts, shards, capacity)
    for _ in range(rounds):
        wishes = materialize(_wishes(state, claimed, counts, capacity, shards), "wishes")
        lanes = wishes.where(F.col("lane") != STAYS).groupBy("shard", "lane").count().collect()
        moves = quotas({(r["shard"], r["lane"]): r["count"] for r in lanes if r["lane"] != FREE},
                       {r["shard"]: r["count"] for r in lanes if r["lane"] == FREE})
        if not moves:
            break
        table = spark.createDataFrame(moves, "shard int, lane int, first long, end long, to int")
        asked = numbered(wishes.where(F.col("lane") != STAYS), ["shard", "lane"], buckets, "number")
        # At most shards x shards rows, whatever the number of documents.
        moved = asked.join(F.broadcast(table), (asked["shard"] == table["shard"])
                           & (asked["lane"] == table["lane"])
                           & (asked["number"] >= table["first"])
                           & (asked["number"] < table["end"]), "left")
        moved = moved.select("row_id", "g1", "g2", "linked",
                             F.coalesce(table["to"], asked["shard"]).alias("shard"))
        stay = wishes.where(F.col("lane") == STAYS).select(*moved.columns)
        state = materialize(moved.unionByName(stay), "shards")
        if claimed:
            counts = _large_groups(state, capacity)
    return state


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS,
                    key: str = "doc_id", text: str = "text",
                    bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row of ``docs``."""
    value = F.col(text)
    whole: Column = F.coalesce(value, F.lit(""))
    base = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(key),
        (F.octet_length(whole) + F.lit(8)).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(value).alias("g1"), F.xxhash64(F.lit(7), value).alias("g2"),
        value.isNotNull().alias("has_text"))
    base = materialize(base, "shard-rows")
    rows = base.count()
    buckets = rows // bucket_rows + 1
    groups = base.where("has_text").groupBy("g1", "g2").agg(F.count("*").alias("n"))
    groups = groups.where("n > 1").select("g1", "g2", F.lit(True).alias("many"))
    linked = F.col("has_text") & F.coalesce("many", F.lit(False))
    state = base.select("row_id", "g1", "g2", "has_text").join(groups, ["g1", "g2"], "left").select(
        "row_id", "g1", "g2", linked.alias("linked"))
    state = numbered(state.withColumn("all", F.lit(0)), ["all"], buckets, "number").select(
        *state.columns, F.pmod("number", F.lit(shards)).cast("int").alias("shard"))
    state = propagate(materialize(state, "shards"), shards, rounds, buckets, rows)
    placed = numbered(state.select("row_id", "shard"), ["shard"], buckets, "slot")
    return base.join(placed, "row_id").select(key, "size", "text_crc32", "shard", "slot")


def op2_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shards' row counts are at most one apart."""
    placed = balanced_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         F.col("slot").cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
