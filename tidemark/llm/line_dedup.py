"""Operator 4: lines that a site repeats.

For every host, the pages that contain a line are divided by the host's pages; a line above the
ratio is boilerplate and dropped from all of them.  Pages of a host with the very same text count
as one, above and below the fraction, so that copies of a page do not turn its text into
boilerplate; and a page whose lines are all above the ratio keeps its text, because that is a copy
and a matter for near-duplicate removal.

With ``whole_percent``, as in the pipeline, near copies are shielded too.  A page that would lose more
than ``COPY_PERCENT`` of its words is a near copy of others and keeps them all, so that no stubs are
left where near-duplicate removal is to find copies.  Of the other pages of a host that would lose
the same lines, with more than ``whole_percent`` of their words, one keeps its text, so lines that
a group of like pages shares are never dropped from all of it; the others lose those lines and keep
their own.  The query goes without, as its SQL does.

Lines travel as two 64-bit hashes.  Distinct (host, line, page) rows are shuffled by all three, so
no host and no line gathers in one task; what is joined back is one row a page with lines to drop.
All work on a text is linear in its lines, however long it is.

Defined results: a line is compared without surrounding blanks, tabs and carriage returns; blank
lines are neither counted nor dropped; a null host is a host of its own; a null text stays null
with no lines; repeated rows stay and count once; an empty table gives an empty table.  All input
columns are kept as they are but the text; ``n_lines`` and ``n_dropped`` replace columns so named.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import nested, read_table
from tidemark.runtime import materialize, ship_by_value

ship_by_value(__name__)

PERCENT = 5                    # of a host's pages; a line of more is boilerplate
MIN_PAGES = 3                  # and of at least so many
WHOLE_PERCENT = 50             # of a page's words; losing more, one page of a kind stays whole
COPY_PERCENT = 85              # of a page's words; one that would lose more stays whole
BLANKS = " \t\r"


def line_key(text: Column) -> Column:
    """128 bits of a trimmed line, or null for a blank one."""
    return F.when(text != "", F.struct(F.xxhash64(text).alias("a"),
                                       F.xxhash64(F.lit(7), text).alias("b")))


def weighed_key(text: Column) -> Column:
    """The key of a trimmed line with its number of words."""
    key = line_key(text)
    words = F.size(F.split(text, "[ \t\r]+"))
    return F.when(key.isNotNull(), F.struct(key["a"].alias("a"), key["b"].alias("b"),
                                            words.alias("n")))


def without(seed: int) -> Callable:
    """A function (text, a, b) that takes the lines with these keys out of a text; null if nothing
    else but blank lines would be left.  ``seed`` is that of the second hash."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        digest = xxhash.xxh64_intdigest

        def cleaned(text: str | None, some, others) -> str | None:
            if text is None or some is None:
                return None
            drops = {(x % 2 ** 64, y % 2 ** 64) for x, y in zip(some.tolist(), others.tolist())}
            kept, left, known = [], False, {"": False}
            for line in text.split("\n"):
                shown = line.strip(BLANKS)
                if shown not in known:
                    data = shown.encode()
                    known[shown] = (digest(data, 42), digest(data, seed)) in drops
                if not known[shown]:
                    kept.append(line)
                    left = left or shown != ""
            return "\n".join(kept) if left else None

        return pd.Series([cleaned(*x) for x in zip(texts, a, b)], dtype=object)

    return rest


def unshielded(drops: DataFrame, percent: int) -> DataFrame:
    """Pages with lines to drop, but for near copies and for one of those that would lose the same
    lines and more than the share of their words."""
    drops = materialize(drops.where(F.expr(f"100 * gone <= {COPY_PERCENT} * words")),
                        "lines-to-drop")
    most = drops.where(F.expr(f"100 * gone > {percent} * words"))
    whole = most.groupBy("host", "same").agg(F.min("page").alias("page")).select("host", "page")
    return drops.join(whole, ["host", "page"], "left_anti")


def boilerplate(pages: DataFrame, percent: int = PERCENT,
                min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """From distinct (host, page, line): the lines above the ratio, with their pages."""
    counts = pages.where("line IS NOT NULL").groupBy("host", "line").agg(
        F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = pages.where("line IS NULL").groupBy("host").agg(F.count("*").alias("total"))
    above = counts.join(totals, "host").where(F.expr(f"100 * n > {percent} * total"))
    return above.select("host", "line"), totals


def drop_site_lines(docs: DataFrame, host: str = "source", text: str = "text",
                    percent: int = PERCENT, min_pages: int = MIN_PAGES,
                    whole_percent: int | None = None) -> DataFrame:
    """``docs`` without boilerplate lines, with ``n_lines`` (not blank, before) and ``n_dropped``."""
    value = F.col(f"row.`{text}`")
    rows = nested(docs)
    lines = F.split(value, "\n", -1)
    rows = rows.select(
        "row", F.concat(F.when(F.col(f"row.`{host}`").isNull(), "null").otherwise("host "),
                        F.coalesce(F.col(f"row.`{host}`").cast("string"), F.lit(""))).alias("host"),
        F.struct(F.xxhash64(value).alias("a"), F.xxhash64(F.lit(7), value).alias("b"))
        .alias("page"))
    # Every page also gives a row without a line, which counts the page itself.  What is computed of a
    # whole text stands below the explode, so that it is not computed again for every line.
    key_of, kind = line_key, "struct<a:bigint,b:bigint>"
    if whole_percent is not None:
        key_of, kind = weighed_key, "struct<a:bigint,b:bigint,n:int>"
    trimmed = F.array_distinct(F.transform(lines, lambda x: F.btrim(x, F.lit(BLANKS))))
    keyed = rows.where(value.isNotNull()).select(
        "host", "page", F.transform(trimmed, key_of).alias("keys"))
    if whole_percent is None:
        keyed = keyed.withColumn("words", F.lit(0))
    else:
        keyed = keyed.withColumn("words", F.aggregate(
            "keys", F.lit(0), lambda n, x: n + F.coalesce(x["n"], F.lit(0))))
    seen = keyed.select("host", "page", "words", F.explode(F.concat(
        "keys", F.array(F.lit(None).cast(kind)))).alias("line")).distinct()
    above, _ = boilerplate(seen, percent, min_pages)
    marked = seen.where("line IS NOT NULL").join(above, ["host", "line"], "left_semi")
    drops = marked.groupBy("host", "page").agg(
        F.collect_list(F.struct("line.a", "line.b")).alias("drops"), F.max("words").alias("words"),
        F.struct(F.bit_xor("line.a"), F.bit_xor("line.b")).alias("same"),
        F.sum("line.n" if whole_percent is not None else F.lit(0)).alias("gone"))
    if whole_percent is not None:
        drops = unshielded(drops, whole_percent)
    # These rows grow with the pages: never a side to broadcast.
    joined = rows.join(drops.select("host", "page", "drops").hint("merge"), ["host", "page"], "left")

    seed = docs.sparkSession.range(1).select(F.xxhash64(F.lit(7))).first()[0] % 2 ** 64
    hit = F.col("drops").isNotNull()
    not_blank = F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    out = joined.select(
        "row", not_blank.alias("n"), without(seed)(
            F.when(hit, value), F.transform("drops", lambda x: x["a"]),
            F.transform("drops", lambda x: x["b"])).alias("kept"))
    left = F.size(F.filter(F.split("kept", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    columns = [F.coalesce("kept", value).alias(c) if c == text else F.col(f"row.`{c}`").alias(c)
               for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    n = F.coalesce(F.when(value.isNotNull(), F.col("n")), F.lit(0)).cast("long")
    return out.select(*columns, n.alias("n_lines"),
                      F.when(F.col("kept").isNotNull(), n - left).otherwise(0).cast("long")
                      .alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its source's boilerplate lines."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return drop_site_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


ORACLE = f"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce('h' || source, '') AS host, text
    FROM documents
), totals AS (
    SELECT host, count(DISTINCT text) AS total FROM docs GROUP BY host
), lines AS (
    SELECT rid, host, text, line, i, trim(line, ' ' || chr(9) || chr(13)) AS t
    FROM (SELECT rid, host, text, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(len(string_split(text, chr(10))))) AS i FROM docs)
), above AS (
    SELECT host, t FROM (SELECT host, t, count(DISTINCT text) AS n FROM lines WHERE t <> ''
                         GROUP BY host, t) JOIN totals USING (host)
    WHERE n >= {MIN_PAGES} AND 100 * n > {PERCENT} * total
), marked AS (
    SELECT l.*, l.t <> '' AND a.t IS NOT NULL AS hit
    FROM lines l LEFT JOIN above a ON l.host = a.host AND l.t = a.t
), pages AS (
    SELECT rid, count(*) FILTER (t <> '') AS n_lines, count(*) FILTER (hit) AS hits,
           string_agg(line, chr(10) ORDER BY i) FILTER (NOT hit) AS rest
    FROM marked GROUP BY rid
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines,
       CASE WHEN hits < n_lines THEN hits ELSE 0 END AS n_dropped,
       CASE WHEN hits > 0 AND hits < n_lines THEN rest ELSE text END AS text
FROM docs LEFT JOIN pages USING (rid)
"""
