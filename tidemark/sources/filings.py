"""Filing indexes that arrive as blocks of parallel arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ARRAYS = ("form", "filingDate", "accessionNumber", "primaryDocument")


def explode_blocks(blocks: DataFrame, keep: tuple[str, ...] = ("cik",)) -> DataFrame:
    """One row per filing of a block; a block is as long as its shortest array.

    ``arrays_zip`` would pad the shorter arrays with nulls, hence the cut before it.  The filing
    date stays text here; :func:`tidemark.operators.documents.valid_dates` parses it.
    """
    shortest = F.least(*[F.size(a) for a in _ARRAYS])
    trimmed = [F.slice(F.col(a), F.lit(1), shortest).alias(a) for a in _ARRAYS]
    return (
        blocks.where(shortest > 0)
        .select(*keep, F.posexplode(F.arrays_zip(*trimmed)).alias("pos", "f"))
        .select(*keep, "pos", F.col("f.accessionNumber").alias("accession"),
                F.col("f.form").alias("form"), F.col("f.filingDate").alias("filing_date"),
                F.col("f.primaryDocument").alias("primary_document"))
    )


def full_history(recent: DataFrame, archives: list[DataFrame], cik: str = "cik") -> DataFrame:
    """Every filing of the recent block and the older archive blocks, each accession once.

    The recent block comes before the archives, and archives in the order given; the first
    occurrence of an accession wins.  ``ord`` keeps the original order for later ties.
    """
    parts = [
        explode_blocks(block, (cik, "block_no")).withColumn("source_no", F.lit(i))
        for i, block in enumerate([recent, *archives])
    ]
    rows = reduce(DataFrame.unionByName, parts)
    return keep_first(rows, [cik, "accession"], ["source_no", "block_no", "pos"])


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row per key in the given order.

    A combining ``min_by``: every task keeps one candidate per key before the shuffle, so even a
    key with a huge number of copies sends only one row per task.
    """
    rest = [c for c in rows.columns if c not in key]
    return (
        rows.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
        .select(*key, "_first.*")
    )
