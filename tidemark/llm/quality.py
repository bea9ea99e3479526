"""Operator 6: quality rules as a ledger of bits.

``ledger`` measures every text once, evaluates every rule once and stores the measurements beside
one bit a failed rule.  A policy is a version and the set of rules it enforces; ``apply_policy`` is
one bitwise AND, and ``ablations`` counts, from the groups of equal bits, what each rule rejects
alone, so neither looks at a text again.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows stay; an
empty table gives an empty ledger.  An input column named like one of the ledger's is replaced.
"""

from __future__ import annotations

import operator
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts, read_table
from tidemark.runtime import ship_by_value

ship_by_value(__name__)

WINDOW = 5                     # words of a window looked for again in the same text
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_upper_words", "n_top_word", "n_loud_words", "n_stutters")


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition holds; its place in the list is its bit."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("upper_case", "100 * n_upper_words > 15 * n_words"),
    Rule("one_word", "n_words >= 20 AND 100 * n_top_word > 30 * n_words"),
    Rule("stutter", "100 * n_stutters > 25 * n_words"),
    Rule("loud", "100 * n_loud_words > 10 * n_words"),
    Rule("no_words", "n_words = 0"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << i for i, r in enumerate(rules)}
        return sum(bits[n] for n in set(self.rules))


BASE = Policy("base-1", ("few_words", "repeated_windows"))
FULL = Policy("full-1", tuple(r.name for r in RULES))
# For a corpus that keeps short texts and quotations: the base rules are left out.
LENIENT = Policy("lenient-1", tuple(r.name for r in RULES if r.name not in BASE.rules))


def repeated_words(words: list[str]) -> int:
    """Words in windows that the text has twice or more, the first of them included."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    total = end = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + WINDOW - max(at, end)
            end = at + WINDOW
    return total


def measure(text: str) -> tuple[int, ...]:
    """One text's measurements, in the order of ``MEASURES``."""
    raw = text.encode().split()            # at ASCII white space only
    if not raw:
        return (0, 0, sum(map(text.count, SYMBOLS))) + (0,) * (len(MEASURES) - 3)
    words = b" ".join(raw).decode().split(" ")
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines),
            len(lines) - len(set(lines)), repeated_words(words),
            sum(w.isupper() and len(w) > 1 for w in words), max(Counter(words).values()),
            sum(w.endswith("!!") for w in words), sum(map(operator.eq, words, words[1:])))


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measurements and ``fail_bits``."""

    def run(texts: list[str]) -> dict[str, pa.Array]:
        columns = zip(*map(measure, texts))
        return {n: pa.array(c, pa.int64()) for n, c in zip(MEASURES, columns)}

    measured = map_texts(docs, text, ", ".join(f"{m} long" for m in MEASURES), run)
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(0).cast("long"))
    return measured.withColumn("fail_bits", bits)


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0


def apply_policy(stored: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's rows with ``policy`` and ``kept``."""
    return stored.withColumn("policy", F.lit(policy.version)).withColumn(
        "kept", passes(policy, rules))


def ablations(stored: DataFrame, policies: tuple[Policy, ...],
              rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents that the rule fails, that the policy
    rejects, and that it rejects for this rule alone (those kept if the rule were dropped).

    Documents are first counted by their bits, so what follows has at most a row a combination.
    """
    counts = stored.groupBy("fail_bits").agg(F.count("*").alias("n"))
    bits = {r.name: 1 << i for i, r in enumerate(rules)}
    wanted = F.array(*[F.struct(F.lit(p.version).alias("policy"), F.lit(n).alias("rule"),
                                F.lit(p.mask(rules)).cast("long").alias("mask"),
                                F.lit(bits[n]).cast("long").alias("bit"))
                       for p in policies for n in p.rules])
    failed = F.expr("fail_bits & w.mask")
    return counts.withColumn("w", F.explode(wanted)).groupBy("w.policy", "w.rule").agg(
        F.sum(F.when(F.expr("(fail_bits & w.bit) <> 0"), F.col("n")).otherwise(0)).alias("fails"),
        F.sum(F.when(failed != 0, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(failed == F.col("w.bit"), F.col("n")).otherwise(0)).alias("alone"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements and verdicts of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = apply_policy(ledger(docs), FULL)
    return stored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", (~passes(BASE)).alias("base_failed"), "kept",
                         "fail_bits", "policy")


WORD = r"[^\x20\x09-\x0D]+"

ORACLE = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
    SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS ws,
           list_filter(string_split(text, chr(10)),
                       lambda x: regexp_matches(x, '{WORD}')) AS ls
    FROM docs
), words AS (
    SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM split
), windows AS (
    SELECT rid, i, w || ' ' || lead(w, 1) OVER p || ' ' || lead(w, 2) OVER p || ' ' ||
           lead(w, 3) OVER p || ' ' || lead(w, 4) OVER p AS g
    FROM words WINDOW p AS (PARTITION BY rid ORDER BY i)
), counted AS (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows WHERE g IS NOT NULL
), repeated AS (
    SELECT rid, count(DISTINCT i + o) AS n FROM counted, (SELECT unnest(range(5)) AS o)
    WHERE n >= 2 GROUP BY rid
), top AS (
    SELECT rid, max(n) AS n FROM (SELECT rid, w, count(*) AS n FROM words GROUP BY rid, w)
    GROUP BY rid
), stutters AS (
    SELECT rid, count(*) AS n FROM (
        SELECT rid, w, lag(w) OVER (PARTITION BY rid ORDER BY i) AS v FROM words)
    WHERE w = v GROUP BY rid
), measured AS (
    SELECT s.doc_id, len(ws)::BIGINT AS n_words,
           length(array_to_string(ws, ''))::BIGINT AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
           len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
           coalesce(r.n, 0)::BIGINT AS n_repeat_words,
           len(list_filter(ws, lambda x: length(x) > 1 AND regexp_matches(x, '\p{{Lu}}')
               AND NOT regexp_matches(x, '\p{{Ll}}'))) AS n_upper_words,
           coalesce(t.n, 0) AS n_top_word,
           len(list_filter(ws, lambda x: suffix(x, '!!'))) AS n_loud_words,
           coalesce(u.n, 0) AS n_stutters
    FROM split s LEFT JOIN repeated r USING (rid) LEFT JOIN top t USING (rid)
    LEFT JOIN stutters u USING (rid)
), judged AS (
    SELECT *, ({" + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END"
                           for i, r in enumerate(RULES))})::BIGINT AS fail_bits FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       fail_bits = 0 AS kept, fail_bits, '{FULL.version}' AS policy
FROM judged
"""
