"""Bars, events, filings and so on, derived from the given tables with Spark."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.operators import split
from tidemark.operators.textual import LexiconScorer
from tidemark.plans import features
from tidemark.sources import market

AS_OF = "2001-06-30"

# The invented prose never uses the real tone words, so frequent words stand in for them.
TONE_PROXY = {
    "uncertainty_ratio": ("of", "that", "was"),
    "hedging_ratio": ("and", "it", "that"),
    "forward_guidance_strength": ("to", "for", "be"),
    "litigious_ratio": ("in", "on", "with"),
}
POLARITY_PROXY = {"positive": ("the", "is", "this"), "negative": ("at", "by", "from")}


class Views:
    """Derived tables of one scale-factor directory; everything but ``imputed`` is lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}
        self.scorer = LexiconScorer(POLARITY_PROXY, TONE_PROXY)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def trades(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_brand")
        return self.table("lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("p_brand").alias("ticker"), F.col("l_shipdate").cast("date").alias("date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), "l_quantity",
            F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("at"))

    @cached_property
    def bars(self) -> DataFrame:
        raw = self.trades.groupBy("ticker", "date").agg(
            F.min_by("price", "at").alias("open"), F.max("price").alias("high"),
            F.min("price").alias("low"), F.max_by("price", "at").alias("close"),
            F.sum("l_quantity").alias("volume"))
        return market.clean_bars(raw)

    @cached_property
    def calendar(self) -> DataFrame:
        """Last urgent order of each brand and quarter, as a calendar of time stamps."""
        urgent = self.table("orders").where(F.col("o_orderpriority") == "1-URGENT").select(
            "o_orderkey", "o_orderdate")
        lines = self.table("lineitem").select("l_orderkey", "l_partkey")
        part = self.table("part").select("p_partkey", "p_brand")
        return (
            lines.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("p_brand").alias("ticker"),
                     F.date_trunc("quarter", "o_orderdate").alias("quarter"))
            .agg(F.max("o_orderdate").cast("timestamp_ntz").alias("event_ts"))
            .drop("quarter"))

    @cached_property
    def events(self) -> DataFrame:
        return market.latest_events(market.calendar_events(self.calendar, AS_OF))

    @cached_property
    def filings(self) -> DataFrame:
        doc = F.col("doc_id")
        number = (1 + F.substring("source", 4, 10).cast("int")).cast("string")
        form = F.element_at(F.array(*[F.lit(f) for f in ("8-K", "8-K/A", "10-Q", "10-Q/A", "10-K")]),
                            (F.expr("doc_id div 20") % 5 + 1).cast("int"))
        return self.table("documents").select(
            F.concat(F.lit("Brand#"), number).alias("ticker"), F.lpad(number, 10, "0").alias("cik"),
            F.lpad(doc.cast("string"), 10, "0").alias("accession"),
            F.date_add(F.lit("1995-01-01").cast("date"), (doc * 37 % 2404).cast("int"))
            .alias("filing_date"),
            form.alias("form"), "text", doc.alias("ord"))

    @cached_property
    def scored_filings(self) -> DataFrame:
        return self.scorer.in_place(self.filings.select("accession", "text"))

    def filing_blocks(self, filings: DataFrame, shortened: bool = False) -> DataFrame:
        """Index blocks of parallel arrays, at most 100 filings each.  With ``shortened``, the array
        of document names lacks its last entry in every other block, so that the shortest array
        decides."""
        rows = F.array_sort(F.collect_list(F.struct(
            "ord", "form", F.date_format("filing_date", "yyyy-MM-dd").alias("filingDate"),
            F.col("accession").alias("accessionNumber"),
            F.concat(F.lit("doc"), F.col("ord"), F.lit(".htm")).alias("primaryDocument"))))
        grouped = filings.groupBy("cik", F.expr("ord div 2000").alias("block_no")).agg(
            rows.alias("rows"))
        return grouped.select(
            "cik", "block_no", *[F.col(f"rows.{c}").alias(c)
                                 for c in ("form", "filingDate", "accessionNumber")],
            F.slice("rows.primaryDocument", F.lit(1), F.size("rows") - F.when(
                F.lit(shortened) & (F.col("block_no") % 2 == 0), 1).otherwise(0))
            .alias("primaryDocument"))

    @cached_property
    def registry_payloads(self) -> DataFrame:
        """Two-entry registry payloads per part: the brand and the part's own name."""
        entry = F.create_map(
            F.lit("0"), F.struct(F.lower("p_brand").alias("ticker"),
                                 F.col("p_partkey").alias("cik_str")),
            F.lit("1"), F.struct(F.concat(F.lit("part-"), F.col("p_size")).alias("ticker"),
                                 (F.col("p_partkey") + 10_000_000_000).alias("cik_str")))
        return self.table("part").select(F.col("p_partkey").alias("ord"),
                                         F.to_json(entry).alias("payload"))

    @cached_property
    def filing_documents(self) -> DataFrame:
        """Groups of five pages: the first is the primary document, the others alternates."""
        from tidemark.functions.text import html_to_text
        return self.table("pages").select(
            F.expr("page_id div 5").alias("accession"), (F.col("page_id") % 5).alias("doc_no"),
            F.col("url").alias("name"), html_to_text(F.col("html")).alias("text"))

    @cached_property
    def price_features(self) -> DataFrame:
        return features.event_price_features(self.events, self.bars)

    @cached_property
    def raw_matrix(self) -> DataFrame:
        return features.raw_matrix(self.events, self.filings, self.bars, self.scorer)

    @cached_property
    def imputed(self) -> DataFrame:
        return features.feature_matrix(self.raw_matrix)

    def split(self, ratio: float = settings.TRAIN_RATIO) -> tuple[DataFrame, DataFrame]:
        return split.chronological_split(self.imputed, ratio)

    @cached_property
    def predictions(self) -> DataFrame:
        """A rule predictor on the test rows: direction from the gap, magnitude from momentum."""
        _, test = self.split()
        rows = []
        for h in settings.TARGET_HORIZONS:
            actual = F.col(f"ret_{h}d").alias("actual")
            up = (F.col("post_earnings_gap") >= 0).cast("double")
            for kind, name, value in (("direction", "gap_sign", up),
                                      ("magnitude", "momentum",
                                       0.1 * F.col("pre_earnings_momentum"))):
                rows.append(F.struct(
                    F.lit(f"{kind}_{h}d_{name}").alias("model"), F.lit(kind).alias("model_type"),
                    F.lit(h).alias("horizon"), "ticker", "event_date", actual,
                    value.alias("predicted")))
        return test.select(F.inline(F.array(*rows)))
