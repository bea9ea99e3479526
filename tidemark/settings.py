"""Defaults of every tunable.  All of them can be overridden by operator arguments."""

# --- fixed values: names, sizes and limits that results depend on -------------------------------

MAX_EVENTS_PER_ENTITY = 20
PRE_DAYS = 30            # calendar days before the event, inclusive
POST_DAYS = 15           # calendar days after the event, exclusive
TARGET_HORIZONS = (1, 3)
TRAIN_RATIO = 0.70
SEED = 42

FORM_TYPES = ("8-K", "10-Q")
FILING_WINDOW_DAYS = 30
FILING_FALLBACK_DAYS = 60
MIN_FILING_WORDS = 50

CHUNK_TOKENS = 510
SCORER_BATCH = 8

META_COLUMNS = ("ticker", "event_date")
TEXT_FEATURES = (
    "sentiment_score",
    "positive_prob",
    "negative_prob",
    "neutral_prob",
    "uncertainty_ratio",
    "hedging_ratio",
    "forward_guidance_strength",
    "litigious_ratio",
)
PRICE_FEATURES = (
    "pre_earnings_momentum",
    "pre_earnings_volatility",
    "post_earnings_gap",
    "volume_spike",
    "amihud_illiquidity",
)
MISSING_FLAG = "text_missing"
FEATURE_COLUMNS = TEXT_FEATURES + PRICE_FEATURES + (MISSING_FLAG,)

DIRECTION_MODELS = ("logistic", "random_forest", "gradient_boosting")
MAGNITUDE_MODELS = ("ridge", "random_forest", "gradient_boosting")
MIN_TRAIN_ROWS = 5
FAILURE_TOP_K = 5
HISTOGRAM_BINS = 20
EXTENT_MARGIN = 0.005

# --- sizes that only steer execution ------------------------------------------------------------

# Values between a median's brackets that one task looks at in the end.
BRACKET_VALUES = 20_000

# Rows of one entity and time bucket that a task of an interval join takes; more are dealt to several.
HEAVY_BUCKET_ROWS = 100_000
