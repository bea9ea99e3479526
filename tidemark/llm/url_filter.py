"""Operator 1: URL filters from a tree of path templates.

Rules come first: the longest rule whose host is the URL's host or a parent domain of it, and whose
path the URL's path starts with, decides.  Other URLs are judged by the template of their path:

1. digits in segments are generalised, and equal shapes of a host are counted once from there on;
2. level by level, children of a tree node whose labelled purity does not differ significantly from
   that of their siblings become a wildcard, and so do those with few of its URLs and few labels;
3. a template whose purity, smoothed towards its host's and that towards the whole, is too low and
   rests on enough labels is rejected.

Everything is built-in expressions, combining aggregates and joins.  Only distinct shapes with their
counts pass through the tree.  A shape leaves it at its end, or where no other shape of its node goes
on, as nothing is left to decide there; the tree ends when all have left.

The SQL of op1 merges every child with few URLs and joins what lies beyond ``LEVELS`` to one segment;
the given pages have neither such children that differ nor such paths.

Defined results: without ``://`` (or null) host and path are empty and no rule fits; templates
without labels take their host's purity; repeated rows stay; an empty table gives an empty table.
Input columns cannot clash, as only the url and the columns named in ``keep`` are read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table
from tidemark.runtime import materialize

LEVELS = 4                     # of the SQL
RARE_PERCENT = 2               # of its parent's URLs; a child with less needs LEAST_LABELS
CRITICAL = 3.84                # of z squared: 95 per cent
STRENGTH = 10                  # labels that a prior counts for
LEAST_LABELS = 5
LEAST_PURITY = 0.5
Rule = tuple[str, str, str]    # host, path, verdict

RULES: tuple[Rule, ...] = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule for the columns host and path, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, outcome in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit(f".{host}"))) & F.startswith(
            "path", F.lit(path))
        name = F.when(fits, F.lit(host + path)).otherwise(name)
        verdict = F.when(fits, F.lit(outcome)).otherwise(verdict)
    return name, verdict


def path_shape(path: Column) -> Column:
    """Segments with digits generalised."""
    return F.split(F.regexp_replace(path, "[0-9]+", "{n}"), "/", -1)


def _level(shapes: DataFrame, level: int) -> DataFrame:
    """Decide the segments of one level of open shapes: ``prefix`` grows by them.

    Those that end or are the only one of their node that goes on get their whole template.
    """
    shapes = shapes.withColumn("segment", F.get("shape", F.lit(level)))
    node = ["host", "prefix"]
    children = shapes.groupBy(*node, "segment").agg(
        F.sum("n").alias("n"), F.sum("labels").alias("labels"), F.sum("good").alias("good"))
    parents = children.groupBy(*node).agg(
        F.sum("n").alias("all_n"), F.sum("labels").alias("all_labels"),
        F.sum("good").alias("all_good"))
    both = children.join(parents, node)
    others = F.col("all_labels") - F.col("labels")
    # Purities with one good and one bad label added; z squared of their difference.
    p = (F.col("good") + 1.0) / (F.col("labels") + 2.0)
    q = (F.col("all_good") - F.col("good") + 1.0) / (others + 2.0)
    r = (F.col("all_good") + 1.0) / (F.col("all_labels") + 2.0)
    spread = r * (1.0 - r) * (1.0 / (F.col("labels") + 2.0) + 1.0 / (others + 2.0))
    alone = F.col("n") == F.col("all_n")
    unknown = (F.col("n") * 100 < F.col("all_n") * RARE_PERCENT) & (F.col("labels") < LEAST_LABELS)
    differs = (p - q) * (p - q) > F.lit(CRITICAL) * spread
    chosen = F.when(alone | (~unknown & differs), F.col("segment")).otherwise("*")
    decided = both.select(*node, "segment", chosen.alias("chosen"))
    joined = shapes.join(decided, [*node, "segment"])
    grown = F.concat("prefix", F.lit("" if level == 0 else "/"), "chosen")
    joined = joined.select("host", "shape", "n", "labels", "good", grown.alias("prefix"))
    more = F.col("size") > level + 1
    going = joined.withColumn("size", F.size("shape"))
    # How many shapes of the grown node go on: merged children are one node.
    nodes = going.where(more).groupBy(*node).agg(F.count("*").alias("going"))
    going = going.join(nodes, node, "left")
    rest = F.array_join(F.slice("shape", F.lit(level + 2), F.greatest(
        F.col("size") - F.lit(level + 1), F.lit(0))), "/")
    only = more & (F.col("going") == 1)
    return going.select("host", "shape", "n", "labels", "good", F.when(
        only, F.concat("prefix", F.lit("/"), rest)).otherwise(F.col("prefix")).alias("prefix"),
        (more & ~only).alias("open"))


def path_templates(urls: DataFrame) -> DataFrame:
    """From (host, path, labels, good): template and smoothed purity of every (host, shape)."""
    shapes = urls.withColumn("shape", path_shape(F.col("path"))).groupBy(
        "host", "shape").agg(F.count("*").alias("n"), F.sum("labels").alias("labels"),
                             F.sum("good").alias("good"))
    rest = materialize(shapes.withColumn("prefix", F.lit("")), "url-shapes")
    level, done = 0, []
    while not rest.isEmpty():              # stored, as each level reads the one before three times
        stored = materialize(_level(rest, level), "url-shapes")
        done.append(stored.where("NOT open").drop("open"))
        rest = stored.where("open").drop("open")
        level += 1
    shapes = reduce(DataFrame.unionByName, done, rest)
    templates = shapes.groupBy("host", "prefix").agg(F.sum("labels").alias("labels"),
                                                     F.sum("good").alias("good"))
    hosts = templates.groupBy("host").agg(F.sum("labels").alias("host_labels"),
                                          F.sum("good").alias("host_good"))
    prior = hosts.agg((F.sum("host_good") + 1.0) / (F.sum("host_labels") + 2.0)).scalar()
    host = (F.col("host_good") + STRENGTH * prior) / (F.col("host_labels") + F.lit(STRENGTH))
    purity = (F.col("good") + STRENGTH * host) / (F.col("labels") + F.lit(STRENGTH))
    judged = templates.join(hosts, "host").select(
        "host", "prefix", F.col("labels").alias("template_labels"), purity.alias("purity"))
    return shapes.select("host", "shape", "prefix").join(judged, ["host", "prefix"])


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[Rule] = RULES,
                url: str = "url", keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """host, path, rule, verdict, template, template_labels and purity of every page's URL.

    ``labelled`` has (url, good): a labelled URL each, good or not.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    none = F.lit(0).cast("long")
    host, path = url_parts(F.col("url"))
    labels = labelled.where("good IS NOT NULL").select(
        host.alias("host"), path.alias("path"), F.lit(1).cast("long").alias("labels"),
        F.col("good").cast("long").alias("good"))
    # Pages count towards a node's URLs, labelled URLs towards its purity.
    urls = rows.select("host", "path", none.alias("labels"), none.alias("good"))
    templates = path_templates(urls.unionByName(labels))
    rule, verdict = fitting_rule(rules)
    bad = (F.col("template_labels") >= LEAST_LABELS) & (F.col("purity") < LEAST_PURITY)
    judged = rows.withColumn("shape", path_shape(F.col("path"))).join(
        templates, ["host", "shape"], "left")
    return judged.select(
        *keep, "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.col("prefix").alias("template"), "template_labels", F.round("purity", 9).alias("purity"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page.

    The number in a page's path is the id of the document that it shows; a page is good if that
    document is labelled as of quality and not as toxic.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    _, path = url_parts(F.col("url"))
    shown = F.expr("try_cast(number AS BIGINT)")
    numbers = pages.select("url", F.regexp_extract(path, "/([0-9]+)", 1).alias("number")).select(
        "url", shown.alias("doc_id"))
    return filter_urls(pages, numbers.join(labels, "doc_id").select("url", "good"))


def _oracle() -> str:
    rule, verdict = "NULL::VARCHAR", "NULL::VARCHAR"
    for host, path, outcome in sorted(RULES, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = f"(host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{path}')"
        rule = f"CASE WHEN {fits} THEN '{host}{path}' ELSE {rule} END"
        verdict = f"CASE WHEN {fits} THEN '{outcome}' ELSE {verdict} END"
    seg = "string_split(regexp_replace(path, '[0-9]+', '{n}', 'g'), '/')"
    shape = (f"CASE WHEN len({seg}) > {LEVELS} THEN list_append({seg}[:{LEVELS}], "
             f"array_to_string({seg}[{LEVELS + 1}:], '/')) ELSE {seg} END")
    levels, last = [], "s0"
    for i in range(LEVELS + 1):
        levels.append(f"""
c{i} AS (SELECT host, prefix, shape[{i + 1}] AS segment, sum(n) AS n, sum(labels) AS labels,
    sum(good) AS good FROM {last} WHERE shape[{i + 1}] IS NOT NULL GROUP BY ALL),
p{i} AS (SELECT host, prefix, sum(n) AS all_n, sum(labels) AS all_labels, sum(good) AS all_good
    FROM c{i} GROUP BY ALL),
z{i} AS (SELECT c.*, all_n, (good + 1e0) / (labels + 2e0) AS p,
    (all_good - good + 1e0) / (all_labels - labels + 2e0) AS q,
    (all_good + 1e0) / (all_labels + 2e0) AS r,
    1e0 / (labels + 2e0) + 1e0 / (all_labels - labels + 2e0) AS m
    FROM c{i} c JOIN p{i} USING (host, prefix)),
d{i} AS (SELECT host, prefix, segment, CASE WHEN n = all_n OR (NOT n * 100 < all_n * {RARE_PERCENT}
    AND (p - q) * (p - q) > {CRITICAL}::DOUBLE * (r * (1e0 - r) * m)) THEN segment ELSE '*' END
    AS chosen FROM z{i}),
s{i + 1} AS (SELECT s.host, s.shape, s.n, s.labels, s.good,
    CASE WHEN chosen IS NULL THEN s.prefix ELSE s.prefix || '{'/' if i else ''}' || chosen END
    AS prefix FROM {last} s LEFT JOIN d{i} d
    ON s.host = d.host AND s.prefix = d.prefix AND s.shape[{i + 1}] = d.segment)""")
        last = f"s{i + 1}"
    return f"""
WITH parts AS (
    SELECT page_id, url, coalesce(CASE WHEN contains(url, '://') THEN
        substr(url, instr(url, '://') + 3) ELSE '' END, '') AS rest FROM pages
), urls AS (
    SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')
        AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), marks AS (
    SELECT doc_id, min(quality = 1 AND toxic = 0) AS good FROM labels
    WHERE doc_id IS NOT NULL GROUP BY doc_id
), counted AS (
    SELECT host, path, 0 AS labels, 0 AS good FROM urls
    UNION ALL
    SELECT host, path, 1, good::INT FROM urls JOIN marks
    ON try_cast(regexp_extract(path, '/([0-9]+)', 1) AS BIGINT) = doc_id WHERE good IS NOT NULL
), s0 AS (
    SELECT host, {shape} AS shape, count(*) AS n, sum(labels) AS labels, sum(good) AS good,
           '' AS prefix FROM counted GROUP BY 1, 2
), {",".join(levels)},
templates AS (
    SELECT host, prefix, sum(labels) AS labels, sum(good) AS good FROM {last} GROUP BY ALL
), hosts AS (
    SELECT host, sum(labels) AS labels, sum(good) AS good FROM templates GROUP BY ALL
), whole AS (
    SELECT (sum(good) + 1e0) / (sum(labels) + 2e0) AS prior FROM hosts
), judged AS (
    SELECT t.host, t.prefix, t.labels, (t.good + {STRENGTH}::DOUBLE *
        ((h.good + {STRENGTH}::DOUBLE * prior) / (h.labels + {STRENGTH}::DOUBLE)))
        / (t.labels + {STRENGTH}::DOUBLE) AS purity
    FROM templates t JOIN hosts h USING (host), whole
)
SELECT page_id, u.host, path, {rule.replace("host", "u.host")} AS rule,
       coalesce({verdict.replace("host", "u.host")}, CASE WHEN j.labels >= {LEAST_LABELS} AND purity
       < {LEAST_PURITY} THEN 'block' ELSE 'allow' END) AS verdict,
       j.prefix AS template, j.labels::BIGINT AS template_labels, round(purity, 9) AS purity
FROM urls u LEFT JOIN {last} s ON u.host = s.host AND {shape} = s.shape
LEFT JOIN judged j ON j.host = s.host AND j.prefix = s.prefix
"""


ORACLE = _oracle()
