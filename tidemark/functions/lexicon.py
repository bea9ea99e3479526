"""The tone word lists: data, not code.  Any other lexicon can be passed wherever one is taken."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# --- fixed values: tone words of the Loughran-McDonald (2011) kind ------------------------------
# A term may stand in more than one list.

UNCERTAINTY = """
approximate approximation assume assumed assumption assumptions believe believed contingency
contingent could depend dependent depending depends doubt doubtful estimate estimated estimates
estimation eventual eventually exposure fluctuate fluctuation fluctuations indefinite indefinitely
indicate indicating inherent inherently may might nearly occasionally pending perhaps possible
possibly predict predicted predicting prediction predictions preliminary presumably probable
probably projected projecting projection projections random randomly reassess reassessment
recalculate reconsider reestimate reexamine reinterpret revise revised revision risk risky roughly
speculate speculative suggest suggested suggesting susceptible tending tentative tentatively
uncertain uncertainty unclear undecided undefined undetermined unforeseeable unknown unlikely
unpredictable unproven unquantifiable unsettled unspecified untested variable variability vary
varying volatile volatility
"""

HEDGING = """
almost apparent apparently appear appeared appears conceivable conceivably conditional
conditionally fairly generally hopefully largely likelihood moderately mostly partially partly
possibility possibly potentially practically presumably probably relatively seemingly somewhat
substantially suggests typically usually
"""

FORWARD_GUIDANCE = """
anticipate anticipated anticipates anticipating expect expected expects expecting forecast
forecasted forecasting forecasts guidance guide guided guides guiding intend intended intending
intends objective objectives outlook plan planned planning plans project projected projecting
projects strategy strategic target targeted targeting targets will
"""

LITIGIOUS = """
adjudicate adjudicated adjudication allegation allegations allege alleged alleging arbitrate
arbitration claim claims claimant claimants complain complainant complaint complaints conviction
convictions counsel counterclaim court courts decree defendant defendants defense deposition
depositions dispute disputed disputes enjoin enjoined guilty hearing hearings indict indicted
indictment infraction injunction jury law laws lawsuit lawsuits lawyer lawyers legal legislate
legislation liable liability liabilities litigate litigated litigation magistrate motion motions
petition plaintiff plaintiffs plead pleaded pleading prosecution prosecute prosecuted prosecutor
ruling rulings settlement settlements statute statutes statutory subpoena subpoenas sue sued suit
suits testimony testify trial trials tribunal verdict verdicts violation violations
"""

# --- feature name -> terms ----------------------------------------------------------------------

Lexicon = Mapping[str, tuple[str, ...]]

TONE_LEXICON: Lexicon = {
    "uncertainty_ratio": tuple(UNCERTAINTY.split()),
    "hedging_ratio": tuple(HEDGING.split()),
    "forward_guidance_strength": tuple(FORWARD_GUIDANCE.split()),
    "litigious_ratio": tuple(LITIGIOUS.split()),
}

# A small polarity list for the bundled scorer (our own choice; a trained scorer replaces it).
POLARITY_LEXICON: Lexicon = {
    "positive": ("growth", "strong", "record", "exceeded", "improved", "improvement", "gain",
                 "gains", "profit", "profitable", "success", "successful", "increase", "increased"),
    "negative": ("loss", "losses", "decline", "declined", "weak", "weakness", "impairment",
                 "adverse", "decrease", "decreased", "failure", "shortfall", "default", "deficit"),
}


def lexicon_table(spark: SparkSession, lexicon: Lexicon = TONE_LEXICON) -> DataFrame:
    """A lexicon as the (category, term) table that the join-based operators take."""
    rows = [(category, term) for category, terms in lexicon.items() for term in terms]
    return spark.createDataFrame(rows, "category string, term string")
