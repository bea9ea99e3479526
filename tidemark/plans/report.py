"""The evaluation tables as one text report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RULE = "=" * 72


def report_lines(tables: dict[str, DataFrame], title: str = "Results of the evaluation") -> DataFrame:
    """The report as rows ``section, model, block, line_no, line``; sorted, they read top to bottom.

    Lines are formatted where the rows are, so a report over very many entities stays distributed.
    """
    def lines(df: DataFrame, section: int, block: int, text, order, model=F.col("model")):
        return df.select(F.lit(section).alias("section"), model.alias("model"),
                         F.lit(block).alias("block"), order.cast("string").alias("line_no"),
                         text.alias("line"))

    def each(df: DataFrame, block: int, *texts):
        """Several fixed lines per model."""
        return lines(df.select("model", F.posexplode(F.array(*texts))), 1, block, F.col("col"),
                     F.format_string("%06d", "pos"))

    fmt = F.format_string
    cls, cm, reg = tables["class_metrics"], tables["confusion"], tables["regression_metrics"]
    spark = cls.sparkSession
    none = tables["direction_leaderboard"].isEmpty() and tables["magnitude_leaderboard"].isEmpty()
    number = [F.coalesce(c, F.lit(float("nan"))) for c in ("mae", "rmse", "r2", "ic", "ic_pval")]
    parts = [
        each(cls, 0, fmt("[%s] direction", "model"),
             fmt("  share right        %.4f", "accuracy"), fmt("  precision (up)     %.4f", "precision"),
             fmt("  recall (up)        %.4f", "recall"), fmt("  f1 (up)            %.4f", "f1")),
        each(cm, 1, F.lit("  counts, actual by predicted:"), fmt("    down %d %d", "tn", "fp"),
             fmt("    up   %d %d", "fn", "tp")),
        each(cls.select("model"), 2, F.lit("  by class:"), F.lit(
            "       class  precision    recall        f1      rows")),
        lines(tables["class_report"], 1, 3,
              fmt("%12s  %9.2f %9.2f %9.2f %9d", "section", "precision", "recall", "f1",
                  "support"), F.col("section")),
        each(reg, 0, fmt("[%s] magnitude", "model"),
             fmt("  mean abs. error    %.6f", number[0]), fmt("  root mean square   %.6f", number[1]),
             fmt("  explained (r2)     %.4f", number[2]),
             fmt("  rank correlation   %.4f, p-value %.4f", number[3], number[4])),
        each(cls.select("model").unionByName(reg.select("model")), 4,
             F.lit("  by entity:")),
        lines(tables["accuracy_by_entity"], 1, 5,
              fmt("    %-8s %4d rows, %.3f right", "ticker", "n", "accuracy"), F.col("ticker")),
        lines(tables["mae_by_entity"], 1, 5,
              fmt("    %-8s %4d rows, mean abs. error %.6f", "ticker", "n", "mae"), F.col("ticker")),
        each(cls.select("model").unionByName(reg.select("model")), 6,
             F.lit("  furthest off:")),
        lines(tables["worst_directions"], 1, 7,
              fmt("    %s on %s: %+.4f, predicted class %d", "ticker",
                  F.col("event_date").cast("string"), "actual", "predicted_label"),
              fmt("%06d", "rank")),
        lines(tables["worst_magnitudes"], 1, 7,
              fmt("    %s on %s: %+.6f, predicted %+.6f, off by %+.6f", "ticker",
                  F.col("event_date").cast("string"), "actual", "predicted", "error"),
              fmt("%06d", "rank")),
        lines(tables["direction_leaderboard"], 3, 0,
              fmt("  %-40s %7.4f %7.4f %7.4f %7.4f%s", "model", "accuracy", "precision", "recall",
                  "f1", F.when(F.col("is_best"), "  best").otherwise("")),
              fmt("%020.12f", 1 - F.col("f1")), F.lit("")),
        lines(tables["magnitude_leaderboard"], 5, 0,
              fmt("  %-40s %10.6f %10.6f %7.4f %7.4f%s", "model", number[0], number[1], number[2],
                  number[3], F.when(F.col("is_best"), "  best").otherwise("")),
              fmt("%020.12f", "mae"), F.lit("")),
        lines(tables["direction_leaderboard"], 6, 0,
              fmt("%s: %.1f%% right%s", "model", 100 * F.col("accuracy"),
                  F.when(F.col("above_random"), ", better than a coin")
                  .otherwise(", no better than a coin")), F.col("model"), F.lit("")),
    ]
    fixed = [
        (0, "", 0, "0", _RULE), (0, "", 0, "1", title), (0, "", 0, "2", _RULE),
        (2, "", 0, "0", _RULE), (2, "", 0, "1", "All models"), (2, "", 0, "2", _RULE),
        (2, "", 0, "3", "Direction, best f1 first"),
        (2, "", 0, "4", "  %-40s %7s %7s %7s %7s" % ("model", "right", "prec", "recall", "f1")),
        (4, "", 0, "0", "Magnitude, smallest error first"),
        (4, "", 0, "1", "  %-40s %10s %10s %7s %7s" % ("model", "mae", "rmse", "r2", "ic")),
    ]
    if none:
        fixed.append((7, "", 0, "0", "There is nothing to compare: no model was scored."))
    parts.append(spark.createDataFrame(
        fixed, "section int, model string, block int, line_no string, line string"))
    return reduce(DataFrame.unionByName, parts).orderBy("section", "model", "block", "line_no")


def write_report(lines: DataFrame, path: str) -> None:
    """The sorted lines as text; the range sort keeps the file order the reading order."""
    lines.select("line").write.mode("overwrite").text(path)
