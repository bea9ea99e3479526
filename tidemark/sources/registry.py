"""Entity registry: names to zero-padded registry ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas
from tidemark.functions.text import zero_padded


def parse_registry(payloads: DataFrame, json: str = "payload", order: str = "ord") -> DataFrame:
    """Registry payloads (JSON objects of objects) to one row per entity: ``ticker, cik``.

    Where an entity occurs more than once, the last entry of the last payload wins.  The winner is
    found with a combining aggregate, so a name that fills a third of the entries costs no more.
    """
    entries = payloads.select(
        F.col(order).alias("_ord"),
        F.posexplode(F.map_values(F.from_json(json, schemas.REGISTRY_PAYLOAD))).alias("_pos", "e"),
    )
    return (
        entries
        .select(F.upper("e.ticker").alias("ticker"), zero_padded(F.col("e.cik_str")).alias("cik"),
                F.struct("_ord", "_pos").alias("_at"))
        .groupBy("ticker").agg(F.max_by("cik", "_at").alias("cik"))
    )


def with_registry_id(rows: DataFrame, registry: DataFrame, entity: str = "ticker") -> DataFrame:
    """Look up the registry id of each row's entity, case-insensitively; unknown ones get null.

    No broadcast hint: the optimizer broadcasts the registry only when its measured size allows.
    """
    ids = registry.select(F.col("ticker").alias("_name"), "cik")
    return rows.join(ids, F.upper(F.col(entity)) == F.col("_name"), "left").drop("_name")


def document_address(cik: Column, accession: Column, document: Column, base: str) -> Column:
    """Storage path of a document: id without leading zeros / accession without dashes / name."""
    return F.concat_ws("/", F.lit(base), F.regexp_replace(cik, "^0+", ""),
                       F.replace(accession, F.lit("-"), F.lit("")), document)
