"""Price features and forward returns of each event, from the bars around it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.operators.windows import rows_around


def event_bars(events: DataFrame, bars: DataFrame, pre_days: int = settings.PRE_DAYS,
               post_days: int = settings.POST_DAYS) -> DataFrame:
    """The bars in [event - pre_days, event + post_days) of every event."""
    return rows_around(events, bars, pre_days, post_days)


def bar_sequence(windowed: DataFrame, horizons: Iterable[int] = settings.TARGET_HORIZONS
                 ) -> DataFrame:
    """Annotate each event's bars with their neighbours inside the window.

    Adds ``is_pre`` (before the event), ``is_event_bar`` (first bar on or after the event),
    ``prev_close``, ``simple_return``, ``log_return`` and ``lead_{h}``.  The window is cut before
    looking at neighbours, so nothing outside of it can leak in.
    """
    order = "over (partition by ticker, event_date order by date)"
    return windowed.selectExpr(
        "ticker", "event_date", "date", "open", "close", "volume",
        f"lag(close) {order} as prev_close",
        f"lag(date) {order} as prev_date",
        *[f"lead(close, {int(h)}) {order} as lead_{int(h)}" for h in horizons],
    ).selectExpr(
        "* except (prev_date)",
        "date < event_date as is_pre",
        "date >= event_date and coalesce(prev_date < event_date, true) as is_event_bar",
        "try_divide(close, prev_close) - 1 as simple_return",
        "ln(try_divide(close, prev_close)) as log_return",
    )


def price_features(windowed: DataFrame, horizons: Iterable[int] = settings.TARGET_HORIZONS
                   ) -> DataFrame:
    """All price features and forward returns, in one aggregation per event.

    Null rules: momentum needs one return; volatility and illiquidity need three bars before the
    event; the gap falls back to the event bar's own open-to-close move when there is no usable
    previous close; a forward return needs its bar inside the window.
    """
    horizons = [int(h) for h in horizons]
    aggregates = {
        "pre_earnings_volatility":
            "if(count_if(is_pre) >= 3, stddev_samp(log_return) filter (where is_pre), null)",
        "post_earnings_gap":
            "max(if(coalesce(prev_close, 0) <> 0, try_divide(open, prev_close),"
            " try_divide(close, open)) - 1) filter (where is_event_bar)",
        "volume_spike":
            "try_divide(max(volume) filter (where is_event_bar),"
            " avg(volume) filter (where is_pre))",
        "amihud_illiquidity":
            "if(count_if(is_pre) >= 3, avg(try_divide(abs(simple_return), close * volume))"
            " filter (where is_pre and close * volume > 0), null)",
        **{f"ret_{h}d": f"max(try_divide(lead_{h}, close) - 1) filter (where is_event_bar)"
           for h in horizons},
    }
    momentum = F.product(F.expr("if(is_pre, 1 + simple_return, null)")) - 1
    return bar_sequence(windowed, horizons).groupBy("ticker", "event_date").agg(
        momentum.alias("pre_earnings_momentum"),
        *[F.expr(f"{sql} as {name}") for name, sql in aggregates.items()])


def as_of_bars(windowed: DataFrame) -> DataFrame:
    """Per event the last bar strictly before it and the first bar on or after it."""
    day, at = F.col("date"), F.col("event_date")
    return windowed.groupBy("ticker", "event_date").agg(
        F.max(F.when(day < at, day)).alias("prev_date"),
        F.max_by("close", F.when(day < at, day)).alias("prev_close"),
        F.min(F.when(day >= at, day)).alias("bar_date"),
        F.min_by("open", F.when(day >= at, day)).alias("bar_open"),
        F.min_by("close", F.when(day >= at, day)).alias("bar_close"),
    )
