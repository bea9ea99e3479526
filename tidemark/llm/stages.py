"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns documents.

All but the last return the columns they are given.  Those are set aside under working names, so an
extra column may have any name.  Null and empty texts: the quality stage drops them; the others keep
a null text as it is and treat it as empty.  Repeated rows are near duplicates of each other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate as leaks, line_dedup, shared_words
from tidemark.llm import quality as rules
from tidemark.llm.common import brought_back, read_table, set_aside
from tidemark.runtime import discard, materialize, stored_since

_finished: list[str] = []      # tables of the stages before


def begin(docs: DataFrame) -> int:
    """Delete what earlier stages stored, unless ``docs`` still reads it.

    A stage's rows are written before the next one gets them, so its tables have had their use.
    Returns the mark after which the stage's own tables come.
    """
    read = docs.inputFiles()
    done = [p for p in _finished if not any(f"{p}/" in f for f in read)]
    discard(docs.sparkSession, done)
    _finished[:] = [p for p in _finished if p not in done]
    return len(stored_since())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the lenient policy."""
    begin(docs)
    rows, names = set_aside(docs)
    judged = rules.ledger(rows, names["text"]).where(rules.passes(rules.LENIENT))
    return brought_back(judged, names)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines; ``n_chars`` follows the text."""
    begin(docs)
    rows, names = set_aside(docs)
    cleaned = brought_back(line_dedup.drop_site_lines(
        rows, names["source"], names["text"], whole_percent=line_dedup.WHOLE_PERCENT), names)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.length("text").cast(kind)
        cleaned = cleaned.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return cleaned


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the smallest id, the first stored row among equal ids.

    Texts are near duplicates by their fingerprints (at most 4 bits, as in operator 9) or by 0.8 of
    their five-word shingles.
    """
    mark = begin(docs)
    rows, names = set_aside(docs)
    stored = shared_words.with_bands(rows, names["text"]).withColumn(
        "row_id", F.monotonically_increasing_id())
    stored = materialize(stored, "fingerprinted")
    key = F.col(f"`{names['doc_id']}`")
    order = F.struct(key.isNull().alias("unnamed"), key.alias("key"), "row_id")
    classes = shared_words.near_duplicates(stored, names["text"], order)
    keepers = materialize(classes.select(F.col("component.row_id")).distinct(), "keepers")
    own = stored_since(mark)
    _finished.extend(own)
    # Only the stored rows and the keepers are read from here on.
    kept = set(stored.inputFiles() + keepers.inputFiles())
    discard(spark, [p for p in own if not any(f"{p}/" in f for f in kept)])
    # Merged at every size, as the keepers grow with the input.
    return brought_back(stored.join(keepers.hint("merge"), "row_id", "left_semi"), names)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    begin(docs)
    rows, names = set_aside(docs)
    found = leaks.find_leaks(rows, read_table(spark, sf_dir, "benchmark"), names["text"])
    return brought_back(found.where(F.size("leaks") == 0), names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``ids`` and ``n_tokens``."""
    begin(docs)
    path = public_tokenizers.path(bpe.RANK_FILE)
    return bpe.encode(docs, path).drop("offsets").withColumn("n_tokens", bpe.token_count())
