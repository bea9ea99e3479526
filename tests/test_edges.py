"""Hand-made edge cases of each operator."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark import schemas, settings
from tidemark.functions.lexicon import TONE_LEXICON, lexicon_table
from tidemark.functions.text import html_to_text, long_enough, word_count, zero_padded
from tidemark.operators import curves, documents, fusion, metrics, prices, textual, windows
from tidemark.plans import collect, features
from tidemark.runtime import shared_folder, ship_by_value
from tidemark.sources import filings, market, registry, store

ship_by_value(__name__)

DAY = dt.date(2024, 3, 2)      # a Saturday


def day(offset):
    return DAY + dt.timedelta(offset)


def bars(spark, rows, ticker="A"):
    """rows: (day offset, open, close, volume)"""
    return spark.createDataFrame(
        [(ticker, day(d), o, o, o, c, v) for d, o, c, v in rows],
        "ticker string, date date, open double, high double, low double, close double, "
        "volume double")


def events(spark, *offsets, ticker="A"):
    return spark.createDataFrame([(ticker, day(o)) for o in offsets],
                                 "ticker string, event_date date")


def price_row(spark, rows):
    e, b = events(spark, 0), bars(spark, rows)
    return prices.price_features(prices.event_bars(e, b)).first()


# --- price features -----------------------------------------------------------------------------

def test_event_on_a_day_without_a_bar(spark):
    r = price_row(spark, [(-2, 9.0, 10.0, 5.0), (-1, 10.0, 11.0, 15.0), (2, 12.1, 12.0, 40.0),
                          (3, 12.0, 15.0, 1.0)])
    assert r["post_earnings_gap"] == pytest.approx(12.1 / 11 - 1)
    assert r["volume_spike"] == pytest.approx(4.0)
    assert r["ret_1d"] == pytest.approx(0.25) and r["ret_3d"] is None
    assert r["pre_earnings_momentum"] == pytest.approx(0.1)
    assert r["pre_earnings_volatility"] is None and r["amihud_illiquidity"] is None


def test_three_bars_before_the_event(spark):
    r = price_row(spark, [(-5, 1.0, 10.0, 1.0), (-4, 1.0, 11.0, 0.0), (-3, 1.0, 12.0, 2.0)])
    returns = [math.log(1.1), math.log(12 / 11)]
    mean = sum(returns) / 2
    assert r["pre_earnings_volatility"] == pytest.approx(
        math.sqrt(sum((x - mean) ** 2 for x in returns)))
    assert r["amihud_illiquidity"] == pytest.approx((12 / 11 - 1) / 24)   # zero volume left out
    assert r["post_earnings_gap"] is None and r["volume_spike"] is None and r["ret_1d"] is None


def test_gap_falls_back_to_the_event_bar(spark):
    assert price_row(spark, [(0, 10.0, 11.0, 1.0)])["post_earnings_gap"] == pytest.approx(0.1)
    zero = price_row(spark, [(-1, 1.0, 0.0, 1.0), (0, 10.0, 12.0, 1.0)])
    assert zero["post_earnings_gap"] == pytest.approx(0.2)
    assert price_row(spark, [(0, 0.0, 11.0, 1.0)])["post_earnings_gap"] is None


def test_zero_volume_and_zero_base(spark):
    r = price_row(spark, [(-2, 1.0, 1.0, 0.0), (-1, 1.0, 1.0, 0.0), (0, 1.0, 0.0, 5.0),
                          (1, 1.0, 2.0, 5.0)])
    assert r["volume_spike"] is None and r["ret_1d"] is None


def test_window_bounds(spark):
    rows = [(-31, 1.0, 1.0, 1.0), (-30, 1.0, 2.0, 1.0), (14, 1.0, 3.0, 1.0), (15, 1.0, 4.0, 1.0)]
    got = prices.event_bars(events(spark, 0), bars(spark, rows)).collect()
    assert sorted(r["date"] for r in got) == [day(-30), day(14)]


def test_return_is_not_taken_across_the_window_start(spark):
    r = price_row(spark, [(-31, 1.0, 100.0, 1.0), (-30, 1.0, 2.0, 1.0), (-29, 1.0, 3.0, 1.0)])
    assert r["pre_earnings_momentum"] == pytest.approx(0.5)


def test_momentum_telescopes(spark):
    closes = [3.0, 4.5, 2.25, 9.0, 7.0]
    r = price_row(spark, [(-10 + i, 1.0, c, 1.0) for i, c in enumerate(closes)])
    assert r["pre_earnings_momentum"] == pytest.approx(closes[-1] / closes[0] - 1)


def test_overlapping_events_see_the_same_bars(spark):
    b = bars(spark, [(o, 1.0, 1.0 + i, 1.0) for i, o in enumerate(range(-60, 60))])
    got = prices.event_bars(events(spark, -20, 0, 1, 20), b).groupBy("event_date").count()
    assert {r["count"] for r in got.collect()} == {45}


def test_salting_changes_nothing(spark):
    rows = _filings(spark, *[(i % 150 - 75, "8-K", i % 3 > 0) for i in range(600)])
    e = events(spark, 0, 10, -40)
    plain, salted = (documents.filings_near(e, rows, 30, salts=n) for n in (1, 4))
    assert plain.count() == salted.count() > 0
    assert plain.exceptAll(salted.select(*plain.columns)).count() == 0
    picks = [sorted(map(tuple, documents.pick_filing(e, rows, [], F.col("usable"), salts=n)
                        .collect())) for n in (1, 4)]
    assert picks[0] == picks[1] and len(picks[0]) == 3


def test_heavy_buckets_alone_are_dealt_to_several_tasks(spark):
    hot = spark.range(20_000).select(F.lit("A").alias("ticker"), F.lit(day(3)).alias("date"), "id")
    rest = spark.range(20_000).select(
        F.concat(F.lit("B"), F.col("id") % 400).alias("ticker"),
        F.date_add(F.lit(day(0)), (F.col("id") % 7).cast("int")).alias("date"), F.col("id") + 20_000)
    rows = hot.unionByName(rest.toDF("ticker", "date", "id"))
    e = rows.select("ticker").distinct().withColumn("event_date", F.lit(day(0)))
    e = e.unionByName(events(spark, 40))
    options = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1",
               "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        plain, dealt = (windows.rows_around(e, rows, 10, 10, heavy_rows=n) for n in (None, 500))
        sizes = [sorted(r["count"] for r in d.groupBy(F.spark_partition_id()).count().collect())
                 for d in (plain, dealt)]
        assert sizes[0][-1] > 3 * sizes[0][len(sizes[0]) // 2]
        assert len(sizes[1]) == 8 and sizes[1][-1] <= 3 * sizes[1][4]
        heavy = windows.heavy_buckets(rows, ["ticker", "date"], 500).collect()
        assert [tuple(r) for r in heavy] == [("A", day(3), 40)]
        assert plain.count() == dealt.count() == 40_000
        assert plain.exceptAll(dealt.select(*plain.columns)).count() == 0
        assert windows.rows_around(e, rows.limit(0), 10, 10, heavy_rows=1).count() == 0
        assert windows.rows_around(e.limit(0), rows, 10, 10, heavy_rows=1).count() == 0
        picks = [windows.rows_around(e, rows, 10, 10, heavy_rows=n).groupBy("ticker").agg(
            F.sum("id")).collect() for n in (1, 10**9)]
        assert sorted(picks[0]) == sorted(picks[1])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- events and bars ----------------------------------------------------------------------------

def test_calendar_keeps_wall_time_and_drops_later_today(spark):
    rows = spark.sql("""select * from values
        ('A', timestamp_ntz'2024-03-02 00:00:00'), ('A', timestamp_ntz'2024-03-02 16:00:00'),
        ('A', timestamp_ntz'2024-03-01 23:30:00'), ('A', timestamp_ntz'2024-03-01 08:00:00'),
        ('B', null) as t(ticker, event_ts)""")
    got = market.calendar_events(rows, "2024-03-02")
    assert sorted(r["event_date"] for r in got.collect()) == [day(-1), day(0)]


def test_latest_events(spark):
    e = events(spark, *range(30)).unionByName(events(spark, 1, 2, ticker="B"))
    got = market.latest_events(e, 3)
    assert sorted((r[0], r[1]) for r in got.collect()) == [
        ("A", day(27)), ("A", day(28)), ("A", day(29)), ("B", day(1)), ("B", day(2))]


def test_clean_bars_keeps_known_columns(spark):
    raw = spark.sql("select 'A' ticker, timestamp'2024-03-02 00:00:00' Date, 1 Open, "
                    "cast(null as double) Close, 5 dividends union all "
                    "select 'A', timestamp'2024-03-03 00:00:00', 1, 2.0D, 5")
    got = market.clean_bars(raw)
    assert got.columns == ["ticker", "date", "open", "close"]
    assert [r["date"] for r in got.collect()] == [day(1)]


# --- registry and filings -----------------------------------------------------------------------

def test_registry(spark):
    rows = spark.createDataFrame([
        (0, '{"0": {"ticker": "aapl", "cik_str": 1}, "1": {"ticker": "MSFT", "cik_str": 12345678901}}'),
        (1, '{"0": {"ticker": "AAPL", "cik_str": 2}, "1": {"ticker": "aapl", "cik_str": 3}}'),
    ], "ord long, payload string")
    reg = registry.parse_registry(rows)
    assert {tuple(r) for r in reg.collect()} == {("AAPL", "0000000003"), ("MSFT", "12345678901")}
    found = registry.with_registry_id(
        spark.createDataFrame([("aapl",), ("none",)], "ticker string"), reg)
    assert {tuple(r) for r in found.collect()} == {("aapl", "0000000003"), ("none", None)}
    path = spark.range(1).select(registry.document_address(
        F.lit("0000320193"), F.lit("0000320193-24-000001"), F.lit("a.htm"), "root").alias("p"))
    assert path.first()["p"] == "root/320193/000032019324000001/a.htm"


def test_blocks_and_history(spark):
    schema = ("cik string, block_no long, form array<string>, filingDate array<string>, "
              "accessionNumber array<string>, primaryDocument array<string>")
    recent = spark.createDataFrame(
        [("1", 0, ["8-K", "10-Q"], ["2024-01-02", "2024-01-01"], ["a", "b"], ["x", "y"])], schema)
    older = spark.createDataFrame(
        [("1", 0, ["8-K/A", "10-K", "8-K"], ["2023-01-01", "2023-01-02", "2023-01-03"],
          ["b", "c", "d"], ["z", "z"]),
         ("1", 1, ["4"], ["2020-01-01"], ["c"], ["w"]), ("2", 0, [], [], [], [])], schema)
    got = filings.full_history(recent, [older]).withColumn("ord", F.col("pos"))
    rows = documents.newest_first(got).collect()
    assert [(r["accession"], r["form"]) for r in rows] == [
        ("a", "8-K"), ("b", "10-Q"), ("c", "10-K")]


def test_forms(spark):
    rows = spark.createDataFrame([(f,) for f in ("8-k", "8-K/a", "10-Q", "10-K", "8-K/A/A", "8-")],
                                 "form string")
    assert [r[0] for r in documents.of_forms(rows).collect()] == ["8-k", "8-K/a", "10-Q"]
    amended = rows.where(documents.form_matches(F.col("form"), ["8-K/A"]))
    assert [r[0] for r in amended.collect()] == ["8-K/a", "8-K/A/A"]


def _filings(spark, *rows):
    """rows: (day offset, form, usable)"""
    return spark.createDataFrame(
        [("A", f"f{i}", form, day(d), i, usable) for i, (d, form, usable) in enumerate(rows)],
        "ticker string, accession string, form string, filing_date date, ord long, usable boolean")


def _pick(spark, *rows, **options):
    got = documents.pick_filing(events(spark, 0), _filings(spark, *rows), [], F.col("usable"),
                                **options).collect()
    return got[0]["accession"] if got else None


def test_picks(spark):
    assert _pick(spark, (1, "10-Q", True), (-30, "8-K", True)) == "f1"
    assert _pick(spark, (5, "8-K", True), (9, "8-K", True), (9, "8-K", True)) == "f1"
    assert _pick(spark, (9, "8-K", False), (2, "8-K", True)) == "f1"
    assert _pick(spark, (9, "8-K", False), (2, "10-Q", True)) == "f1"
    assert _pick(spark, (31, "8-K", True)) == "f0"               # only the wide window has one
    assert _pick(spark, (61, "8-K", True), (-61, "8-K", True)) is None
    assert _pick(spark, (3, "8-K/A", True), (40, "8-K", True)) is None   # amendment keeps it narrow
    assert _pick(spark, (3, "8-K", False), (40, "8-K", True)) is None
    assert _pick(spark, (3, "8-K", True), (-9, "8-K", True), causal=True) == "f1"
    assert _pick(spark) is None


def test_fallback_window(spark):
    e = events(spark, 0)
    near = documents.filings_with_fallback(e, _filings(spark, (30, "8-K", True), (31, "8-K", True)))
    assert [r["accession"] for r in near.collect()] == ["f0"]
    wide = documents.filings_with_fallback(e, _filings(spark, (31, "8-K", True), (-60, "8-K", True)))
    assert {r["gap_days"] for r in wide.collect()} == {31, 60}


def test_alternate_documents(spark):
    long, short = "w " * 50, "w " * 49
    def choose(*docs):
        rows = [("k", n, name, text) for n, name, text in docs]
        df = spark.createDataFrame(rows, "accession string, doc_no int, name string, text string")
        got = documents.primary_or_alternate(df).collect()
        return got[0]["doc_no"] if got else None
    assert choose((0, "a.txt", long), (1, "b.htm", long)) == 0
    assert choose((0, "a.htm", short), (2, "c.html", long), (1, "b.pdf", long)) == 2
    assert choose((0, "a.htm", short), (1, "b.htm", short)) == 0
    assert choose((0, "a.htm", ""), (1, "b.htm", short)) is None
    assert choose((1, "b.htm", long)) is None


# --- text ---------------------------------------------------------------------------------------

def test_word_gate(spark):
    texts = ["", "   ", "a", " a b\tc\n", "w " * 49, "w " * 50, "w " * 51, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", word_count(F.col("t")).alias("n"), long_enough(F.col("t")).alias("ok"))
    got = [(r["n"], r["ok"]) for r in rows.orderBy("i").collect()]
    assert got == [(0, False), (0, False), (1, False), (3, False), (49, False), (50, True),
                   (51, True), (0, False)]


def test_html(spark):
    html = ("<html><head><style>p {}</style><script>if (a<b) x='</p>';</script></head><body>"
            "<!-- no <b>this</b> --><p>One&nbsp;&amp;lt; two</p><br/>three\n\n four</body></html>")
    got = spark.createDataFrame([(html,)], "h string").select(html_to_text(F.col("h"))).first()[0]
    assert got == "One &lt; two three four"


def test_character_references(spark):
    cases = {"a&#8217;b&#x2019;c&#160;d&eacute;": "a\u2019b\u2019c dé", "&#0;&#xD800;": "\ufffd\ufffd",
             "AT&T &unknown; &# &;&amp;amp;": "AT&T &unknown; &# &;&amp;", "x &Aacute &hellip;": "x &Aacute …",
             "seen<script>var a = 1;": "seen", "a<STYLE x>b</style >c": "a c"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    got = {r[0]: r[1] for r in df.select("h", html_to_text(F.col("h"))).collect()}
    assert got == cases


def test_zero_padding(spark):
    got = spark.createDataFrame([(7,), (12345678901,)], "n long").select(zero_padded(F.col("n")))
    assert [r[0] for r in got.collect()] == ["0000000007", "12345678901"]


def test_lexicon(spark):
    assert [len(t) for t in TONE_LEXICON.values()] == [99, 32, 39, 94]
    docs = spark.createDataFrame([
        (1, "We may possibly EXPECT a lawsuit; we don't plan."), (2, ""), (3, "123 !")],
        "doc_id int, text string")
    wide = {r["doc_id"]: r for r in textual.lexicon_ratios(docs).collect()}
    # 10 tokens: we may possibly expect a lawsuit we don t plan
    assert wide[1]["uncertainty_ratio"] == pytest.approx(0.2)
    assert wide[1]["hedging_ratio"] == pytest.approx(0.1)
    assert wide[1]["forward_guidance_strength"] == pytest.approx(0.2)
    assert wide[1]["litigious_ratio"] == pytest.approx(0.1)
    assert all(wide[i][c] == 0.0 for i in (2, 3) for c in TONE_LEXICON)
    long = textual.lexicon_ratios_from_table(docs, lexicon_table(spark), "doc_id").collect()
    assert {(r["doc_id"], r["category"]): r["ratio"] for r in long} == {
        (i, c): wide[i][c] for c in TONE_LEXICON for i in (1, 2, 3)}


def _fake_model():
    return lambda texts: [(float(len(t.split())), 0.0, 0.0) for t in texts]


def test_scorers_agree_and_sum_to_one(spark):
    polarity = {"positive": ("up", "good"), "negative": ("down",)}
    docs = spark.createDataFrame([
        (1, "up " * 300 + "down good mixed " * 100), (2, "down"), (3, ""), (4, None)],
        "doc_id int, text string")
    inline = textual.polarity_sentiment(docs, polarity, chunk_tokens=70).drop("text")
    chunked = textual.sentiment_from_chunks(docs, "doc_id", textual.polarity_scorer(polarity),
                                            chunk_tokens=70)
    a = {r["doc_id"]: r for r in inline.collect()}
    b = {r["doc_id"]: r for r in chunked.collect()}
    for i in (1, 2, 3, 4):
        for c in settings.TEXT_FEATURES[:4]:
            assert a[i][c] == pytest.approx(b[i][c], abs=1e-12)
    assert a[1]["positive_prob"] + a[1]["negative_prob"] + a[1]["neutral_prob"] == pytest.approx(1)
    assert a[3]["neutral_prob"] == 0.0


def test_chunks_count_equally(spark):
    docs = spark.createDataFrame([(1, "w " * 7)], "doc_id int, text string")
    got = textual.sentiment_from_chunks(docs, "doc_id", textual.batch_scorer(_fake_model),
                                        chunk_tokens=5).first()
    want = sum(math.exp(n) / (math.exp(n) + 2) for n in (5, 2)) / 2
    assert got["positive_prob"] == pytest.approx(want)


class _Custom(textual.TextScorer):
    def sentiment(self, docs, key):
        return textual.sentiment_from_chunks(docs, key, textual.batch_scorer(_fake_model))

    def tone(self, docs, key):
        return textual.lexicon_ratios(docs.select(key, "text")).drop("text")


def test_custom_scorer_runs_on_the_chosen_filings(spark):
    texts = _filings(spark, (1, "8-K", True), (2, "10-K", True)).withColumn(
        "text", F.expr("repeat('may ', 60)"))
    got = features.event_text_features(events(spark, 0), texts, _Custom()).collect()
    assert len(got) == 1 and got[0]["uncertainty_ratio"] == 1.0
    assert got[0]["positive_prob"] == pytest.approx(1.0)


# --- fusion and store ---------------------------------------------------------------------------

def _store_inputs(spark):
    texts = _filings(spark, (1, "8-K", True)).withColumn("text", F.expr("repeat('may ', 60)"))
    b = bars(spark, [(o, 1.0, 1.0 + 0.01 * (o % 7), 1.0) for o in range(-90, 40)])
    return texts, b


def test_imputation_leaves_no_nulls(spark):
    texts, b = _store_inputs(spark)
    e = events(spark, 0, -200, -60)
    raw = features.raw_matrix(e, texts, b)
    done = features.feature_matrix(raw)
    missing = fusion.missing_counts(done, fusion.imputed_columns(done)).collect()
    assert done.count() == 3 and all(r["n_missing"] == 0 for r in missing)
    flags = {r["event_date"]: r["text_missing"] for r in done.collect()}
    assert flags == {day(0): False, day(-200): True, day(-60): True}
    kept = features.feature_matrix(raw, impute_targets=False)
    assert kept.where("ret_1d is null").count() == 1
    first = raw.where(F.col("event_date") == F.lit(day(0)))
    other = features.feature_matrix(raw, fit_on=first, approximate=True)
    assert other.where("volume_spike is null").count() == 0


def test_collecting_twice_adds_nothing(spark):
    texts, b = _store_inputs(spark)
    root = f"{shared_folder(spark)}/edge-{dt.datetime.now().timestamp()}"
    first = collect.collect_events(spark, events(spark, 0), texts, b, root)
    assert [tuple(r) for r in first.collect()] == [("A", day(0), True, True)]
    n_bars = spark.read.parquet(f"{root}/bars").count()
    collect.collect_events(spark, events(spark, 0), texts, b, root)
    assert spark.read.parquet(f"{root}/bars").count() == n_bars == 45
    more = collect.collect_events(spark, events(spark, 0, -300), texts, b, root)
    assert {tuple(r) for r in more.collect()} == {
        ("A", day(0), True, True), ("A", day(-300), False, False)}
    assert store.coverage(more).first()["n_text"] == 1
    collect.collect_events(spark, events(spark, 0), texts, b, root, force=True)
    assert spark.read.parquet(f"{root}/bars").count() == 45
    stored = [spark.read.parquet(f"{root}/{n}") for n in ("texts", "bars")]
    assert store.manifest_or_scan(spark, f"{root}/manifest", *stored).count() == 1
    assert store.manifest_or_scan(spark, f"{root}/nothing", *stored).count() == 1


def test_forcing_one_event_leaves_the_others(spark):
    texts, b = _store_inputs(spark)
    root = f"{shared_folder(spark)}/edge-{dt.datetime.now().timestamp()}"
    collect.collect_events(spark, events(spark, 0, -20), texts, b, root)
    before = {r["event_date"]: r["n"] for r in collect.stored_parts(spark, root)[1].groupBy(
        "event_date").agg(F.count("*").alias("n")).collect()}
    fewer = b.where(F.col("date") >= F.lit(day(0)))
    collect.collect_events(spark, events(spark, 0), texts, fewer, root, force=True)
    after = {r["event_date"]: r["n"] for r in collect.stored_parts(spark, root)[1].groupBy(
        "event_date").agg(F.count("*").alias("n")).collect()}
    assert after[day(-20)] == before[day(-20)] and after[day(0)] < before[day(0)]


def _files(spark, root, name, ticker):
    rows = spark.read.schema(schemas.STORED_BARS if name == "bars" else schemas.STORED_TEXTS).parquet(
        f"{root}/{name}")
    return {r[0] for r in rows.where(F.col("ticker") == ticker).select(
        "_metadata.file_path").distinct().collect()}


def _two_entities(spark):
    texts, b = _store_inputs(spark)
    both = [d.unionByName(d.withColumn("ticker", F.lit("B /%"))) for d in (events(spark, 0), texts, b)]
    root = f"{shared_folder(spark)}/edge-{dt.datetime.now().timestamp()}"
    collect.collect_events(spark, *both, root)
    return root, *both


def test_forcing_rewrites_only_the_entities_it_names(spark):
    root, e, texts, b = _two_entities(spark)
    before = {(n, t): _files(spark, root, n, t) for n in ("texts", "bars") for t in ("A", "B /%")}
    assert all(before.values())
    told = collect.collect_events(spark, e.where("ticker = 'A'"), texts, b, root, force=True)
    after = {(n, t): _files(spark, root, n, t) for n, t in before}
    assert all((before[k] == after[k]) == (k[1] != "A") for k in before)
    assert {tuple(r) for r in told.collect()} == {(t, day(0), True, True) for t in ("A", "B /%")}


def test_forcing_without_results_removes_what_was_stored(spark):
    root, e, texts, b = _two_entities(spark)
    told = collect.collect_events(spark, e.where("ticker <> 'A'"), texts.limit(0), b, root, force=True)
    assert {tuple(r) for r in told.collect()} == {("A", day(0), True, True),
                                                  ("B /%", day(0), False, True)}
    assert not _files(spark, root, "texts", "B /%") and _files(spark, root, "bars", "B /%")


def test_a_failing_force_leaves_the_store_as_it_was(spark):
    root, e, texts, b = _two_entities(spark)
    stored = [sorted(map(tuple, d.collect())) for d in collect.stored_parts(spark, root)]
    broken = b.withColumn("volume", F.expr("if(date > date'1900-01-01', raise_error('x'), volume)")
                          .cast("double"))
    with pytest.raises(Exception):
        collect.collect_events(spark, e, texts, broken, root, force=True)
    assert [sorted(map(tuple, d.collect())) for d in collect.stored_parts(spark, root)] == stored


def test_filings_from_an_index(spark):
    arrays = "form array<string>, filingDate array<string>, accessionNumber array<string>, " \
             "primaryDocument array<string>"
    recent = spark.createDataFrame(
        [("1", 0, ["8-K", "10-K", "8-K/A"], ["2024-03-01", "2024-03-01", "bad"], list("abc"), list("xyz")),
         ("9", 0, ["8-K"], ["2024-03-01"], ["a"], ["x"])], f"cik string, block_no int, {arrays}")
    older = spark.createDataFrame(
        [("1", 0, ["10-Q", "10-Q"], ["2020-01-01", "2021-01-01"], ["a", "d"], ["x", "x"])],
        f"cik string, block_no int, {arrays}")
    long = " ".join(["word"] * 300)
    pages = spark.createDataFrame(
        [("1", "a", 0, "p.htm", "short"), ("1", "a", 1, "q.htm", long), ("9", "a", 0, "p.htm", long)],
        "cik string, accession string, doc_no int, name string, text string")
    known = spark.createDataFrame([("A", "1"), ("C", "1"), ("N", None), ("Z", "9")],
                                  "ticker string, cik string")
    names = spark.createDataFrame([("a",), ("c",), ("n",), ("a",)], "ticker string")
    got = collect.filings_from_index(known, recent, [older], pages, names).collect()
    # The recent block's "a" wins; "b" has another form and "c" no date; "d" has no text.
    assert sorted((r["ticker"], r["accession"], r["form"], r["text"]) for r in got if r["text"]) == [
        ("A", "a", "8-K", long), ("C", "a", "8-K", long)]
    assert sorted((r["ticker"], r["accession"]) for r in got if r["text"] is None) == [
        ("A", "d"), ("C", "d")]
    assert collect.filings_from_index(known.limit(0), recent, [older], pages).count() == 0


def test_a_store_without_texts_and_with_numeric_tickers(spark):
    texts, b = _store_inputs(spark)
    named = [d.withColumn("ticker", F.lit("0700")) for d in (events(spark, 0), texts, b)]
    root = f"{shared_folder(spark)}/edge-{dt.datetime.now().timestamp()}"
    for _ in range(2):
        rows = collect.collect_events(spark, named[0], named[1].limit(0), named[2], root).collect()
        assert [tuple(r) for r in rows] == [("0700", day(0), False, True)]
    scanned = store.scan_manifest(*collect.stored_parts(spark, root)).collect()
    assert [tuple(r) for r in scanned] == [("0700", day(0), False, True)]


def test_filers_sharing_an_accession_keep_their_texts(spark):
    texts, _ = _store_inputs(spark)
    both = texts.unionByName(texts.withColumns({
        "ticker": F.lit("B"), "text": F.concat(F.lit("other "), "text")}))
    e = events(spark, 0)
    e = e.unionByName(e.withColumn("ticker", F.lit("B")))
    got = features.event_texts(e, both).collect()
    assert len(got) == 2
    assert all(r["text"].startswith("other ") == (r["ticker"] == "B") for r in got)


# --- metrics and curves -------------------------------------------------------------------------

def _predictions(spark, rows):
    """rows: (model, type, ticker, day offset, actual, predicted)"""
    return spark.createDataFrame(
        [(m, k, 1, t, day(d), a, p) for m, k, t, d, a, p in rows],
        "model string, model_type string, horizon int, ticker string, event_date date, "
        "actual double, predicted double")


def test_one_class_only(spark):
    p = _predictions(spark, [("m", "direction", "A", i, 0.0, 1.0) for i in range(3)])
    r = metrics.class_metrics(p).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 1.0, 1.0, 1.0)
    assert {x["section"] for x in metrics.classification_report(p).collect()} == {
        "1", "accuracy", "macro avg", "weighted avg"}
    none = _predictions(spark, [("m", "direction", "A", i, -1.0, 0.0) for i in range(3)])
    r = metrics.class_metrics(none).first()
    assert (r["accuracy"], r["precision"], r["recall"], r["f1"]) == (1.0, 0.0, 0.0, 0.0)


def test_constant_predictions(spark):
    rows = [("flat", "magnitude", "A", i, 0.5, 0.5) for i in range(4)]
    rows += [("off", "magnitude", "A", i, 0.5, 0.6) for i in range(4)]
    rows += [("one", "magnitude", "A", 0, 0.5, 0.6)]
    got = {r["model"]: r for r in metrics.regression_metrics(_predictions(spark, rows)).collect()}
    assert got["flat"]["r2"] == 1.0 and got["flat"]["ic"] is None
    assert got["off"]["r2"] == 0.0 and got["one"]["r2"] is None and got["one"]["ic"] is None


def test_perfect_rank_correlation(spark):
    rows = [("up", "magnitude", "A", i, float(i), float(i ** 3)) for i in range(9)]
    rows += [("down", "magnitude", "A", i, float(i), float(-i)) for i in range(9)]
    got = {r["model"]: r for r in
           metrics.rank_correlation(_predictions(spark, rows)).collect()}
    assert got["up"]["ic"] == pytest.approx(1.0) and got["down"]["ic"] == pytest.approx(-1.0)
    assert got["up"]["ic_pval"] == pytest.approx(0.0, abs=1e-6)


def test_worst_rows_break_ties_by_date(spark):
    rows = [("m", "direction", "A", i, -0.1, 1.0) for i in range(8)]
    rows += [("m", "direction", "B", 0, 0.9, 1.0)]
    got = metrics.worst_directions(_predictions(spark, rows)).orderBy("rank").collect()
    assert [r["event_date"] for r in got] == [day(i) for i in range(5)]


def test_all_best_models_are_marked(spark):
    rows = [(m, "direction", "A", i, 0.1, 1.0) for m in ("x", "y") for i in range(2)]
    board = metrics.direction_leaderboard(metrics.class_metrics(_predictions(spark, rows)))
    assert [r["is_best"] for r in board.collect()] == [True, True]


def test_return_curves(spark):
    p = _predictions(spark, [("m", "direction", "B", 0, 0.1, 1.0), ("m", "direction", "A", 0, 0.2, 0.0),
                             ("m", "direction", "A", 1, -0.5, 0.0)])
    got = curves.return_curves(p).orderBy("event_index").collect()
    assert [r["cum_strategy"] for r in got] == pytest.approx([0.8, 0.88, 1.32])
    assert [r["cum_buyhold"] for r in got] == pytest.approx([1.2, 1.32, 0.66])
    assert [r["event_index"] for r in got] == [0, 1, 2]


def test_histogram(spark):
    df = spark.createDataFrame([(float(x), 3.0) for x in (0, 1, 10, 10)] + [(None, None)],
                               "sentiment_score double, uncertainty_ratio double")
    rows = curves.histogram(df, bins=5).collect()
    got = {(r["column_name"], r["bin"]): r["n"] for r in rows}
    assert [got[("sentiment_score", b)] for b in range(1, 6)] == [2, 0, 0, 0, 2]
    assert sum(n for (c, _), n in got.items() if c == "uncertainty_ratio") == 4


def test_coefficient_ranking(spark):
    got = curves.coefficient_ranking(spark, "m", [0.5, -0.1, -2.0], ("a", "b", "c")).collect()
    assert [r["feature"] for r in got] == ["b", "a", "c"]
    assert curves.coefficient_ranking(spark, "m", [1.0], ("a", "b")) is None


def _counted(spark, rows):
    """``rows`` and an accumulator of how many of them were worked out so far."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(name):
        seen.add(1)
        return name

    return rows.withColumn("ticker", F.udf(pass_on, "string").asNondeterministic()("ticker")), seen


def test_collecting_works_out_its_events_once(spark):
    texts, b = _store_inputs(spark)
    root = f"{shared_folder(spark)}/edge-{dt.datetime.now().timestamp()}"
    for force in (False, True):
        once, seen = _counted(spark, events(spark, 0, -20))
        told = collect.collect_events(spark, once, texts, b, root, force=force)
        assert told.count() == 2 and seen.value == 2


def test_stored_texts_have_the_schema_of_the_chosen_ones(spark):
    texts, _ = _store_inputs(spark)
    e = events(spark, 0)
    told = [(f.name, f.dataType) for f in features.event_texts_schema(e, texts)]
    assert told == [(f.name, f.dataType) for f in features.event_texts(e, texts).schema]


def test_matrix_works_out_its_events_once(spark):
    texts, b = _store_inputs(spark)
    once, seen = _counted(spark, events(spark, 0, -20))
    assert features.raw_matrix(once, texts, b).count() == 2 and seen.value == 2


def test_text_features_of_repeated_and_unnamed_filings(spark):
    texts, _ = _store_inputs(spark)
    plain = features.event_text_features(events(spark, 0), texts).collect()
    assert len(plain) == 1
    unnamed = texts.withColumn("accession", F.lit(None).cast("string"))
    for odd in (texts.unionByName(texts), unnamed.unionByName(unnamed)):
        assert features.event_text_features(events(spark, 0), odd).collect() == plain
