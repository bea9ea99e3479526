"""Explicit schemas of the records the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

from tidemark import settings


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STRING, DOUBLE, DATE, LONG = T.StringType(), T.DoubleType(), T.DateType(), T.LongType()

REGISTRY_PAYLOAD = T.MapType(STRING, _struct(("ticker", STRING), ("cik_str", LONG)))
REGISTRY = _struct(("ticker", STRING), ("cik", STRING))

FILING_BLOCK = _struct(
    ("form", T.ArrayType(STRING)),
    ("filingDate", T.ArrayType(STRING)),
    ("accessionNumber", T.ArrayType(STRING)),
    ("primaryDocument", T.ArrayType(STRING)),
)
STORED_TEXTS = _struct(("ticker", STRING), ("event_date", DATE), ("accession", STRING),
                       ("form", STRING), ("filing_date", DATE), ("text", STRING))
CALENDAR = _struct(("ticker", STRING), ("event_ts", T.TimestampNTZType()))
BARS = _struct(("ticker", STRING), ("date", DATE), ("open", DOUBLE), ("high", DOUBLE),
               ("low", DOUBLE), ("close", DOUBLE), ("volume", DOUBLE))
STORED_BARS = _struct(("ticker", STRING), ("event_date", DATE), *[
    (f.name, f.dataType) for f in BARS if f.name != "ticker"])
MANIFEST = _struct(("ticker", STRING), ("event_date", DATE),
                   ("has_text", T.BooleanType()), ("has_prices", T.BooleanType()))

def feature_matrix(horizons=settings.TARGET_HORIZONS) -> T.StructType:
    return _struct(
        ("ticker", STRING), ("event_date", DATE), (settings.MISSING_FLAG, T.BooleanType()),
        *[(c, DOUBLE) for c in settings.TEXT_FEATURES + settings.PRICE_FEATURES],
        *[(f"ret_{h}d", DOUBLE) for h in horizons],
    )


PREDICTIONS = _struct(("model", STRING), ("model_type", STRING), ("horizon", T.IntegerType()),
                      ("ticker", STRING), ("event_date", DATE),
                      ("actual", DOUBLE), ("predicted", DOUBLE))
