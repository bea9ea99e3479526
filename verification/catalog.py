"""Every registered query: a name, and a function of the derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.functions.lexicon import lexicon_table
from tidemark.functions.text import html_to_text, word_count
from tidemark.operators import (
    curves,
    documents,
    fusion,
    knn,
    linear,
    metrics,
    prices,
    projection_hash,
    split,
    textual,
)
from tidemark.plans import collect, features
from tidemark.plans import train as training
from tidemark.runtime import materialize, shared_folder, ship_by_value
from tidemark.sources import filings as filing_source
from tidemark.sources import market, registry, store
from verification import models
from verification.views import AS_OF, POLARITY_PROXY, TONE_PROXY, Views

ship_by_value(__name__)

KEY = list(settings.META_COLUMNS)
FEATURES = list(settings.FEATURE_COLUMNS)
TARGETS = [f"ret_{h}d" for h in settings.TARGET_HORIZONS]

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that the order of summation does not show."""
    def rounded(f):
        if f.dataType.simpleString() != "double":
            return F.col(f.name)
        places = 12 if f.name in ("amihud_illiquidity", "median") else digits
        return F.round(f.name, places).alias(f.name)
    return df.select(*[rounded(f) for f in df.schema])


def unique_path(spark: SparkSession, label: str) -> str:
    import uuid
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# --- registry and filing indexes ----------------------------------------------------------------

@query
def registry_lookup(v: Views) -> DataFrame:
    return registry.parse_registry(v.registry_payloads)


@query
def registry_join(v: Views) -> DataFrame:
    known = v.filings.select(F.upper("ticker").alias("ticker"), "cik").distinct()
    return registry.with_registry_id(v.events, known)


@query
def document_addresses(v: Views) -> DataFrame:
    dashed = F.concat(F.substring("accession", 1, 4), F.lit("-"), F.substring("accession", 5, 6))
    return v.filings.select("accession", registry.document_address(
        F.col("cik"), dashed, F.concat(F.lit("doc"), F.col("ord"), F.lit(".htm")), "archive")
        .alias("address"))


@query
def filing_explode(v: Views) -> DataFrame:
    return filing_source.explode_blocks(v.filing_blocks(v.filings, shortened=True),
                                        ("cik", "block_no"))


@query
def filing_history(v: Views) -> DataFrame:
    recent = v.filings.where(F.col("filing_date") >= F.lit("2000-01-01").cast("date"))
    older = v.filings.where(F.col("filing_date") < F.lit("2000-07-01").cast("date"))
    rows = filing_source.full_history(
        v.filing_blocks(recent), [v.filing_blocks(older.withColumn("form", F.lower("form")))])
    return rows.drop("block_no", "pos")


@query
def newest_first(v: Views) -> DataFrame:
    return documents.newest_first(v.filings).select("cik", "accession", "position")


@query
def form_filter(v: Views) -> DataFrame:
    lower = v.filings.select("ticker", "accession", F.lower("form").alias("form"))
    return documents.of_forms(lower)


@query
def valid_dates(v: Views) -> DataFrame:
    doc = F.col("doc_id")
    text = F.concat_ws("-", F.lit("1999"), F.lpad((doc % 14 + 1).cast("string"), 2, "0"),
                       F.lpad((doc % 31 + 1).cast("string"), 2, "0"))
    return documents.valid_dates(v.table("documents").select("doc_id", text.alias("filing_date")))


# --- text ---------------------------------------------------------------------------------------

QUERIES["html_to_text"] = lambda v: v.table("pages").select(
    "page_id", html_to_text(F.col("html")).alias("text"))


@query
def alternate_document(v: Views) -> DataFrame:
    return documents.primary_or_alternate(v.filing_documents)


@query
def word_gate(v: Views) -> DataFrame:
    words = v.table("documents").select("doc_id", word_count(F.col("text")).alias("n_words"))
    return words.withColumn("usable", F.col("n_words") >= settings.MIN_FILING_WORDS)


@query
def lexicon_ratios(v: Views) -> DataFrame:
    docs = v.table("documents").select("doc_id", "text")
    return textual.lexicon_ratios(docs, TONE_PROXY).drop("text")


@query
def lexicon_table_ratios(v: Views) -> DataFrame:
    docs = v.table("documents").select("doc_id", "text")
    return textual.lexicon_ratios_from_table(docs, lexicon_table(v.spark, TONE_PROXY), "doc_id")


@query
def text_chunks(v: Views) -> DataFrame:
    return textual.text_chunks(v.table("documents"), "doc_id").select(
        "doc_id", "chunk_no", F.size("chunk").alias("n_tokens"),
        F.concat_ws(" ", "chunk").alias("chunk"))


@query
def chunk_sentiment(v: Views) -> DataFrame:
    docs = v.table("documents").select("doc_id", "text")
    return tidy(textual.polarity_sentiment(docs, POLARITY_PROXY).drop("text"))


def _polarity_model():
    """A stand-in for a trained model: logits from the shares of polar words in each chunk."""
    positive, negative = set(POLARITY_PROXY["positive"]), set(POLARITY_PROXY["negative"])

    def predict(texts):
        rows = []
        for text in texts:
            words = text.split()
            n = max(len(words), 1)
            rows.append((20.0 * sum(w in positive for w in words) / n,
                         20.0 * sum(w in negative for w in words) / n, 1.0))
        return rows
    return predict


@query
def pluggable_sentiment(v: Views) -> DataFrame:
    docs = v.table("documents").select("doc_id", "text")
    return tidy(textual.sentiment_from_chunks(docs, "doc_id",
                                              textual.batch_scorer(_polarity_model)))


# --- bars and events ----------------------------------------------------------------------------

@query
def ohlcv_bars(v: Views) -> DataFrame:
    return v.bars


@query
def bar_scan(v: Views) -> DataFrame:
    """All bars up to the cut-off, read back from a stored table with the range pushed down."""
    path = unique_path(v.spark, "bars")
    v.bars.write.parquet(path)
    return market.read_bars(v.spark, path, end=AS_OF)


@query
def calendar_events(v: Views) -> DataFrame:
    return market.calendar_events(v.calendar, AS_OF)


@query
def latest_events(v: Views) -> DataFrame:
    return v.events


@query
def event_window(v: Views) -> DataFrame:
    return prices.event_bars(v.events, v.bars)


@query
def window_split(v: Views) -> DataFrame:
    before = F.col("date") < F.col("event_date")
    return prices.event_bars(v.events, v.bars).groupBy(*KEY).agg(
        F.count_if(before).alias("n_pre"), F.count_if(~before).alias("n_post"))


@query
def as_of_bars(v: Views) -> DataFrame:
    return prices.as_of_bars(prices.event_bars(v.events, v.bars))


@query
def bar_returns(v: Views) -> DataFrame:
    rows = prices.bar_sequence(prices.event_bars(v.events, v.bars))
    return rows.select(*KEY, "date", "is_pre", "is_event_bar", F.round("simple_return", 6)
                       .alias("simple_return"), F.round("log_return", 6).alias("log_return"),
                       "lead_1", "lead_3")


def _price_query(name: str, columns: list[str]) -> None:
    QUERIES[name] = lambda v: tidy(v.price_features.select(*KEY, *columns))


for _name, _column in zip(("momentum", "volatility", "gap", "volume_spike", "amihud"),
                          settings.PRICE_FEATURES):
    _price_query(_name, [_column])
_price_query("targets", TARGETS)
_price_query("price_features", [*settings.PRICE_FEATURES, *TARGETS])


# --- choosing filings ---------------------------------------------------------------------------

def _narrow_filings(v: Views) -> DataFrame:
    return documents.of_forms(v.filings).drop("text", "cik")


@query
def filing_window(v: Views) -> DataFrame:
    return documents.filings_near(v.events, _narrow_filings(v),
                                  settings.FILING_WINDOW_DAYS).drop("ord")


@query
def filing_fallback(v: Views) -> DataFrame:
    return documents.filings_with_fallback(v.events, _narrow_filings(v)).drop("ord")


@query
def filing_pick(v: Views) -> DataFrame:
    return features.event_filings(v.events, v.filings)


@query
def event_texts(v: Views) -> DataFrame:
    return features.event_texts(v.events, v.filings)


@query
def event_text_features(v: Views) -> DataFrame:
    return tidy(features.event_text_features(v.events, v.filings, v.scorer))


# --- matrix and store ---------------------------------------------------------------------------

@query
def feature_fusion(v: Views) -> DataFrame:
    return tidy(v.raw_matrix)


@query
def missing_counts(v: Views) -> DataFrame:
    return fusion.missing_counts(v.raw_matrix, fusion.imputed_columns(v.raw_matrix))


@query
def column_medians(v: Views) -> DataFrame:
    """The medians used for imputation, one row per column."""
    stored = materialize(v.raw_matrix, "matrix")
    medians = fusion.column_medians(stored, fusion.imputed_columns(stored))
    return tidy(v.spark.createDataFrame(list(medians.items()), "column_name string, median double"))


@query
def feature_matrix(v: Views) -> DataFrame:
    return store.chronological(tidy(v.imputed))


@query
def matrix_csv(v: Views) -> DataFrame:
    path = unique_path(v.spark, "matrix-csv")
    store.write_matrix(v.imputed, path, "csv")
    return tidy(store.read_matrix(v.spark, path, "csv"))


def _collect(v: Views) -> tuple[str, DataFrame]:
    return _collect_from(v, v.events, v.bars)


def _collect_from(v: Views, events: DataFrame, bars: DataFrame) -> tuple[str, DataFrame]:
    root = unique_path(v.spark, "raw-store")
    return root, collect.collect_events(v.spark, events, v.filings, bars, root)


def _read_twice(v: Views) -> tuple[DataFrame, DataFrame]:
    """Events and bars, stored for queries that collect from them twice."""
    return materialize(v.events, "events"), materialize(v.bars, "bars")


@query
def raw_store(v: Views) -> DataFrame:
    root, _ = _collect(v)
    return collect.stored_parts(v.spark, root)[1].select(
        *KEY, "date", "open", "high", "low", "close", "volume")


@query
def forced_events(v: Views) -> DataFrame:
    """All events stored, then some of them again from bars with other volumes."""
    events, bars = _read_twice(v)
    root, _ = _collect_from(v, events, bars)
    changed = bars.withColumn("volume", F.col("volume") + 1)
    some = events.where(F.dayofmonth("event_date") % 3 == 0)
    collect.collect_events(v.spark, some, v.filings, changed, root, force=True)
    return collect.stored_parts(v.spark, root)[1].select(*KEY, "date", "close", "volume")


@query
def forced_manifest(v: Views) -> DataFrame:
    """The manifest after some of the stored events were collected again: all stay in it."""
    events, bars = _read_twice(v)
    root, _ = _collect_from(v, events, bars)
    some = events.where(F.dayofmonth("event_date") % 3 == 0)
    return collect.collect_events(v.spark, some, v.filings, bars, root, force=True)


@query
def collected_filings(v: Views) -> DataFrame:
    """From registry payloads, index blocks and documents to the stored texts of all events."""
    own = v.filings.select(F.lower("ticker").alias("ticker"), F.col("cik").cast("long").alias("cik_str"))
    payloads = own.distinct().select(
        F.col("cik_str").alias("ord"),
        F.to_json(F.create_map(F.lit("0"), F.struct("ticker", "cik_str"))).alias("payload"))
    known = registry.parse_registry(payloads)
    events = materialize(v.events, "events")
    known = events.select("ticker").distinct().join(       # names as the events write them
        known.withColumnRenamed("ticker", "_name"), F.upper("ticker") == F.col("_name")).drop("_name")
    cut = F.lit("2000-01-01").cast("date")
    pages = v.filings.select("cik", "accession", F.lit(0).alias("doc_no"),
                             F.lit("primary.htm").alias("name"), "text")
    filings = collect.filings_from_index(
        known, v.filing_blocks(v.filings.where(F.col("filing_date") >= cut)),
        [v.filing_blocks(v.filings.where(F.col("filing_date") < cut))], pages)
    root = unique_path(v.spark, "raw-store")
    collect.collect_events(v.spark, events, filings, v.bars, root)
    return collect.stored_parts(v.spark, root)[0].select(
        *KEY, "accession", "form", "filing_date", "text")


@query
def manifest(v: Views) -> DataFrame:
    return _collect(v)[1]


@query
def manifest_scan(v: Views) -> DataFrame:
    root, _ = _collect(v)
    return store.scan_manifest(*collect.stored_parts(v.spark, root))


@query
def coverage(v: Views) -> DataFrame:
    return store.coverage(_collect(v)[1])


@query
def matrix_from_store(v: Views) -> DataFrame:
    root, events = _collect(v)
    return tidy(features.matrix_from_store(
        events, *collect.stored_parts(v.spark, root), v.scorer))


@query
def incremental_events(v: Views) -> DataFrame:
    """Events still to be collected when all available texts are stored already."""
    return store.not_stored(v.events, features.event_filings(v.events, v.filings))


# --- split, scaling, neighbours -----------------------------------------------------------------

def _marked(v: Views, ratio: float) -> DataFrame:
    train = split.find_boundary(v.imputed, ratio).is_train()
    return v.imputed.select(*KEY, train.alias("is_train"))


@query
def chrono_split(v: Views) -> DataFrame:
    return _marked(v, settings.TRAIN_RATIO)


@query
def chrono_split_straddling(v: Views) -> DataFrame:
    return _marked(v, 0.613)


@query
def schema_completion(v: Views) -> DataFrame:
    done = fusion.complete_schema(v.imputed, (*FEATURES, "absent"))
    return tidy(done.select(*KEY, *FEATURES, "absent"))


def _scaled(v: Views) -> tuple[DataFrame, DataFrame]:
    train, test = split.chronological_split(fusion.complete_schema(v.imputed))
    stats = split.scaling_statistics(train)
    return split.scale(train, stats), split.scale(test, stats)


@query
def standard_scale(v: Views) -> DataFrame:
    train, test = _scaled(v)
    return tidy(train.unionByName(test).select(*KEY, *FEATURES))


@query
def direction_labels(v: Views) -> DataFrame:
    train, _ = v.split()
    return train.select(*KEY, *[split.direction_label(F.col(f"ret_{h}d")).alias(f"label_{h}d")
                                for h in settings.TARGET_HORIZONS])


def _observed(v: Views) -> DataFrame:
    """Training rows whose target was observed, by horizon."""
    matrix = features.feature_matrix(v.raw_matrix, impute_targets=False)
    rows, _ = split.chronological_split(matrix)
    parts = [training.training_rows(rows, h, "direction").select(
        *KEY, F.lit(h).alias("horizon"), "label") for h in settings.TARGET_HORIZONS]
    return parts[0].unionByName(parts[1])


@query
def null_targets(v: Views) -> DataFrame:
    return _observed(v)


@query
def training_sizes(v: Views) -> DataFrame:
    """Training rows of each horizon and whether they are enough to fit anything."""
    return _observed(v).groupBy("horizon").agg(F.count("*").alias("n")).withColumn(
        "enough", F.col("n") >= settings.MIN_TRAIN_ROWS)


@query
def class_weights(v: Views) -> DataFrame:
    train, _ = v.split()
    return tidy(split.class_weights(
        train.select(split.direction_label(F.col("ret_1d")).alias("label"))))


def _neighbours(v: Views, target) -> DataFrame:
    train, test = (materialize(d, "scaled") for d in _scaled(v))
    return knn.nearest_neighbours(train.withColumn("label", target), test, FEATURES)


@query
def knn_neighbours(v: Views) -> DataFrame:
    return tidy(_neighbours(v, F.col("ret_1d")).drop("n_label"))


@query
def knn_classify(v: Views) -> DataFrame:
    return knn.knn_classify(_neighbours(v, split.direction_label(F.col("ret_1d"))))


@query
def knn_regress(v: Views) -> DataFrame:
    return tidy(knn.knn_regress(_neighbours(v, F.col("ret_1d"))))


@query
def knn_approximate(v: Views) -> DataFrame:
    """What the approximate search finds of the exact neighbours, and that its distances are true."""
    train, test = (materialize(d, "scaled") for d in _scaled(v))
    train = materialize(train.withColumn("label", F.col("ret_1d")), "labelled")
    exact = materialize(knn.nearest_neighbours(train, test, FEATURES), "exact")
    found = projection_hash.approximate_neighbours(train, test, FEATURES)
    same = found.select(*KEY, "n_ticker", "n_event_date", F.col("distance").alias("own")).join(
        exact, [*KEY, "n_ticker", "n_event_date"])
    told = projection_hash.recall(found, exact)
    true = same.agg(F.count_if(F.abs(F.col("own") - F.col("distance")) > 1e-9).alias("wrong"))
    return told.select("n_queries", "n_wanted", (F.col("recall") >= 0.9).alias("reached")).join(
        F.broadcast(true), F.lit(True)).withColumnRenamed("wrong", "n_wrong_distances")


def _by_horizon(v: Views) -> DataFrame:
    """Training rows of every horizon with ``ret`` and its direction ``label``, stored."""
    train, _ = split.chronological_split(fusion.complete_schema(v.imputed))
    targets = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}d").alias("ret"))
                        for h in settings.TARGET_HORIZONS])
    rows = train.select(*KEY, *FEATURES, F.explode(targets).alias("t")).select(
        *KEY, *FEATURES, "t.*").where("ret IS NOT NULL")
    return materialize(rows.withColumn("label", split.direction_label(F.col("ret"))), "horizons")


@query
def linear_optimality(v: Views) -> DataFrame:
    """Distance of every coefficient of ridge, lasso and logistic models from its optimum."""
    rows = _by_horizon(v)
    sums = linear.moments(rows, FEATURES, "ret", "horizon")
    logistic = linear.fit_logistic(rows, FEATURES, "label", "horizon")
    out = None
    for h, m in sums.items():
        own = rows.where(F.col("horizon") == h)
        for kind, model, target, penalty in (
                ("ridge", linear.ridge(m, FEATURES), "ret", 1.0),
                ("lasso", linear.lasso(m, FEATURES), "ret", 0.001),
                ("logistic", logistic[h], "label", 1.0)):
            part = linear.optimality(own, model, target, kind, penalty).select(
                F.lit(kind).alias("kind"), F.lit(h).alias("horizon"), "feature",
                (F.round("residual", 8) + 0.0).alias("residual"), "n")
            out = part if out is None else out.unionByName(part)
    return out


# --- evaluation ---------------------------------------------------------------------------------

@query
def predictions(v: Views) -> DataFrame:
    return tidy(v.predictions)


def _evaluation(name: str, fn: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda v: tidy(fn(v.predictions))


_evaluation("confusion", metrics.confusion_matrix)
_evaluation("class_metrics", metrics.class_metrics)
_evaluation("class_report", metrics.classification_report)
_evaluation("error_metrics", metrics.error_metrics)
_evaluation("spearman_ic", metrics.rank_correlation)
_evaluation("regression_metrics", metrics.regression_metrics)
_evaluation("per_entity_accuracy", metrics.accuracy_by_entity)
_evaluation("per_entity_mae", metrics.mae_by_entity)
_evaluation("top_failures_direction", metrics.worst_directions)
_evaluation("top_failures_magnitude", metrics.worst_magnitudes)
_evaluation("leaderboard_direction",
            lambda p: metrics.direction_leaderboard(metrics.class_metrics(p)))
_evaluation("leaderboard_magnitude",
            lambda p: metrics.magnitude_leaderboard(metrics.regression_metrics(p)))
_evaluation("pred_extents", metrics.prediction_extents)


def _significant(name: str):
    """About ten significant digits: compounded returns can get very large."""
    scale = f"pow(10D, floor(log10(greatest(abs({name}), 1D))))"
    return F.expr(f"round({name} / {scale}, 9) * {scale} as {name}")


@query
def pnl_curve(v: Views) -> DataFrame:
    return curves.return_curves(v.predictions).select(
        "model", "event_index", *KEY, "position",
        _significant("cum_strategy"), _significant("cum_buyhold"))




@query
def feature_histogram(v: Views) -> DataFrame:
    return tidy(curves.histogram(v.imputed))


QUERIES.update(models.QUERIES)


def build() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Views(spark, sf_dir))
    return {name: bind(fn) for name, fn in QUERIES.items()}
