"""Text features: lexicon ratios and chunked sentiment."""

from __future__ import annotations

import abc
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import settings
from tidemark.functions.lexicon import POLARITY_LEXICON, TONE_LEXICON, Lexicon
from tidemark.functions.numeric import softmax
from tidemark.functions.text import chunks, only, tokens
from tidemark.runtime import ship_by_value

ship_by_value(__name__)

_SENTIMENT = settings.TEXT_FEATURES[:4]
_SHARPNESS = 20.0      # weight of a hit share in the bundled scorer's logits
_NEUTRAL_LOGIT = 1.0


def lexicon_ratios(docs: DataFrame, lexicon: Lexicon = TONE_LEXICON, text: str = "text"
                   ) -> DataFrame:
    """Add one ratio column per lexicon category: hits / max(tokens, 1).

    A projection only: no shuffle, and the text stays where it was read.
    """
    return _with_ratios(docs.withColumn("_tokens", tokens(F.col(text))), lexicon).drop("_tokens")


def _union(lexicon: Lexicon) -> list[str]:
    return sorted({t for terms in lexicon.values() for t in terms})


def _with_ratios(tokenized: DataFrame, lexicon: Lexicon) -> DataFrame:
    """One pass over all tokens finds those of any category; the categories only look at these."""
    return (
        tokenized.withColumn("_hits", F.expr(only("_tokens", _union(lexicon))))
        .withColumns({
            name: F.expr(f"size({only('_hits', terms)}) / greatest(size(_tokens), 1)")
            for name, terms in lexicon.items()})
        .drop("_hits")
    )


def lexicon_ratios_from_table(docs: DataFrame, lexicon: DataFrame, key: str,
                              text: str = "text") -> DataFrame:
    """The same ratios, long form ``key, category, ratio``, for a lexicon of any size in a table.

    Every document has a row in every category of the lexicon, 0 without a hit.  Tokens are counted
    per document and term before they meet the lexicon, so a frequent word is one row a document.
    ``key`` must be unique.
    """
    terms = lexicon.select("category", "term").distinct()
    counted = docs.select(F.col(key), tokens(F.col(text)).alias("_tokens")).select(
        key, F.size("_tokens").alias("_n"), F.explode("_tokens").alias("term")).groupBy(
        key, "term").agg(F.count("*").alias("_hits"), F.max("_n").alias("_n"))
    hits = counted.join(terms, "term").groupBy(key, "category").agg(
        (F.sum("_hits") / F.max("_n")).alias("_ratio"))
    # One array of the lexicon's categories, whatever the number of documents.
    categories = terms.agg(F.collect_set("category").alias("_categories"))
    every = docs.select(key).withColumn("_categories", categories.scalar()).select(
        key, F.explode("_categories").alias("category"))
    return every.join(hits, [key, "category"], "left").select(
        key, "category", F.coalesce("_ratio", F.lit(0.0)).alias("ratio"))


def _polarity_hits(chunk: str, polarity: Lexicon) -> str:
    """SQL text: the polar words of a chunk and its length, found in one pass."""
    return f"named_struct('hits', {only(chunk, _union(polarity))}, 'n', size({chunk}))"


def _polarity_powers(found: str, polarity: Lexicon) -> str:
    """SQL text: the unnormalised softmax of one chunk; shares are at most 1, so no overflow."""
    def power(side: str) -> str:
        share = f"size({only(f'{found}.hits', polarity[side])}) / greatest({found}.n, 1)"
        return f"exp({_SHARPNESS}D * {share})"

    return (f"named_struct('pos', {power('positive')}, 'neg', {power('negative')},"
            f" 'neu', exp({_NEUTRAL_LOGIT}D))")


def _normalised(powers: str, name: str) -> str:
    return f"{powers}.{name} / ({powers}.pos + {powers}.neg + {powers}.neu)"


def polarity_sentiment(docs: DataFrame, polarity: Lexicon = POLARITY_LEXICON, text: str = "text",
                       chunk_tokens: int = settings.CHUNK_TOKENS) -> DataFrame:
    """Add the four sentiment columns with the bundled polarity scorer.

    Same result as chunk, score and average with :func:`sentiment_from_chunks`, but as a
    projection: one document's chunks never leave its row.
    """
    tokenized = docs.withColumn("_tokens", tokens(F.col(text)))
    return _with_polarity(tokenized, polarity, chunk_tokens).drop("_tokens")


def _with_polarity(tokenized: DataFrame, polarity: Lexicon, chunk_tokens: int) -> DataFrame:
    def mean_of(name: str) -> Column:
        total = f"aggregate(_powers, 0D, (acc, p) -> acc + {_normalised('p', name)})"
        return F.expr(f"coalesce(try_divide({total}, size(_powers)), 0D)")

    pieces = chunks("_tokens", chunk_tokens)
    return (
        tokenized
        .withColumn("_powers", F.expr(
            f"transform(transform({pieces}, c -> {_polarity_hits('c', polarity)}),"
            f" h -> {_polarity_powers('h', polarity)})"))
        .withColumns({"positive_prob": mean_of("pos"), "negative_prob": mean_of("neg"),
                      "neutral_prob": mean_of("neu")})
        .withColumn("sentiment_score", F.expr("positive_prob - negative_prob"))
        .drop("_powers")
    )


def text_chunks(docs: DataFrame, key: str, text: str = "text",
                chunk_tokens: int = settings.CHUNK_TOKENS) -> DataFrame:
    """One row per chunk: ``key, chunk_no, chunk`` (array of tokens)."""
    cut = docs.select(key, tokens(F.col(text)).alias("_tokens"))
    return cut.select(
        key, F.posexplode(F.expr(chunks("_tokens", chunk_tokens))).alias("chunk_no", "chunk"))


def polarity_scorer(polarity: Lexicon = POLARITY_LEXICON) -> Callable[[DataFrame], DataFrame]:
    """The bundled scorer in the chunk-table form that any scorer has: adds ``score``."""
    def score(chunk_rows: DataFrame) -> DataFrame:
        found = chunk_rows.withColumn("_h", F.expr(_polarity_hits("chunk", polarity)))
        powers = found.withColumn("_p", F.expr(_polarity_powers("_h", polarity)))
        score_of = ", ".join(f"'{n}', {_normalised('_p', n)}" for n in ("pos", "neg", "neu"))
        return powers.withColumn("score", F.expr(f"named_struct({score_of})")).drop("_h", "_p")
    return score


def batch_scorer(build: Callable[[], Callable[[list[str]], "object"]],
                 batch_size: int = settings.SCORER_BATCH) -> Callable[[DataFrame], DataFrame]:
    """A chunk scorer from a Python model.

    ``build`` runs once per task and returns a function from a list of chunk texts to rows of
    three logits (positive, negative, neutral); their softmax becomes ``score``.  Chunks travel in
    Arrow batches and only the key, number, logits come back.
    """
    def score(chunk_rows: DataFrame) -> DataFrame:
        keys = [c for c in chunk_rows.columns if c != "chunk"]
        flat = chunk_rows.withColumn("chunk", F.concat_ws(" ", "chunk"))

        def run(batches: Iterator) -> Iterator:
            predict = build()
            for pdf in batches:
                texts = pdf["chunk"].tolist()
                logits = []
                for start in range(0, len(texts), batch_size):
                    logits.extend(list(row) for row in predict(texts[start:start + batch_size]))
                out = pdf[keys].copy()
                for i, name in enumerate(("_l0", "_l1", "_l2")):
                    out[name] = [float(row[i]) for row in logits]
                yield out

        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}"
                         for f in flat.schema if f.name in keys)
        scored = flat.mapInPandas(run, f"{kept}, _l0 double, _l1 double, _l2 double")
        p = softmax([F.col("_l0"), F.col("_l1"), F.col("_l2")])
        return scored.select(*keys, F.struct(
            p[0].alias("pos"), p[1].alias("neg"), p[2].alias("neu")).alias("score"))
    return score


def sentiment_from_chunks(docs: DataFrame, key: str, scorer: Callable[[DataFrame], DataFrame],
                          text: str = "text", chunk_tokens: int = settings.CHUNK_TOKENS
                          ) -> DataFrame:
    """Sentiment per document with a pluggable scorer: ``key`` and the four sentiment columns.

    Chunk scores are averaged without weights.  The average combines before its shuffle, which
    therefore carries a few numbers per document and no text.  A document without tokens gets 0s.
    """
    means = (
        scorer(text_chunks(docs, key, text, chunk_tokens))
        .groupBy(key)
        .agg(*[F.avg(f"score.{f}").alias(f"_{f}") for f in ("pos", "neg", "neu")])
    )
    joined = docs.select(key).join(means, key, "left")
    p = {f: F.coalesce(f"_{f}", F.lit(0.0)) for f in ("pos", "neg", "neu")}
    values = (p["pos"] - p["neg"], p["pos"], p["neg"], p["neu"])
    return joined.select(key, *[v.alias(n) for n, v in zip(_SENTIMENT, values)])


class TextScorer(abc.ABC):
    """What to implement to swap the text model: two DataFrame-to-DataFrame steps."""

    @abc.abstractmethod
    def sentiment(self, docs: DataFrame, key: str) -> DataFrame:
        """``key`` plus sentiment_score, positive_prob, negative_prob, neutral_prob."""

    @abc.abstractmethod
    def tone(self, docs: DataFrame, key: str) -> DataFrame:
        """``key`` plus the four lexicon-style ratios."""


class LexiconScorer(TextScorer):
    """The bundled scorer: polarity shares for sentiment, word lists for tone."""

    def __init__(self, polarity: Lexicon = POLARITY_LEXICON, tone: Lexicon = TONE_LEXICON,
                 chunk_tokens: int = settings.CHUNK_TOKENS):
        self.polarity, self.tone_lexicon, self.chunk_tokens = polarity, tone, chunk_tokens

    def sentiment(self, docs: DataFrame, key: str) -> DataFrame:
        return polarity_sentiment(docs.select(key, "text"), self.polarity,
                                  chunk_tokens=self.chunk_tokens).drop("text")

    def tone(self, docs: DataFrame, key: str) -> DataFrame:
        return lexicon_ratios(docs.select(key, "text"), self.tone_lexicon).drop("text")

    def in_place(self, docs: DataFrame) -> DataFrame:
        """Both steps as one projection over the documents, columns added in place."""
        tokenized = docs.withColumn("_tokens", tokens(F.col("text")))
        scored = _with_polarity(tokenized, self.polarity, self.chunk_tokens)
        return _with_ratios(scored, self.tone_lexicon).drop("_tokens")


def text_features(docs: DataFrame, key: str, scorer: TextScorer | None = None) -> DataFrame:
    """``key`` and all eight text features of each document."""
    scorer = scorer or LexiconScorer()
    if isinstance(scorer, LexiconScorer):
        return scorer.in_place(docs.select(key, "text")).select(key, *settings.TEXT_FEATURES)
    return scorer.sentiment(docs, key).join(scorer.tone(docs, key), key).select(
        key, *settings.TEXT_FEATURES)
