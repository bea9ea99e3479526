"""Operator 8: secrets in texts, with credentials linked from their parts.

Strong patterns are always reported.  Weak candidates (an account name, a short or unnamed secret,
an endpoint) mean nothing alone; they are reported only where complementary parts lie in the same
scope.  A part's scope is its interval widened by ``REACH`` code points, and the parts of a text
are linked by an interval join over their sorted intervals: a weak secret needs an identifier or an
endpoint, an account name or an endpoint needs a secret.  An endpoint that holds a weak secret, such
as a link with a long key in its path, does not complement it.  Intervals never cross texts, so one
pass over the texts does it, and each part looks only at its neighbours, however many a text has.

Defined results: a very long text is scanned whole, in time linear in its length but for sorting its
parts; a null or empty text has no spans; repeated rows stay; ties of start are ordered
by kind as listed in ``KINDS``; an empty table gives an empty table.  An input column named like
an output is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts, read_table
from tidemark.runtime import ship_by_value

ship_by_value(__name__)

REACH = 200
BASE_KINDS = ("assign", "access", "hex")
KINDS = BASE_KINDS + ("account", "weak", "endpoint")

# --- fixed values: the base patterns ------------------------------------------------------------
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

# Weak parts.
ACCOUNT = re.compile(r"""\b((?i:user|username|login|account|client_id|access_key_id))["']?\x20*"""
                     r"""[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.ASCII)
SHORT_SECRET = re.compile(r"""\b((?i:password|passwd|pwd|pass|secret|token|api_?key))["']?\x20*"""
                          r"""[:=]\x20*["']?([^\s"']{4,})""", re.ASCII)
UNNAMED = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s"'<>]+|"""
                      r"""\b(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}"""
                      r"""(?::\d{1,5})?""", re.ASCII)

SECRET_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
WEAK_WORDS = SECRET_WORDS + ("pwd", "pass")
ENDPOINT_WORDS = ("://", "host", "endpoint", "server")
ACCOUNT_WORDS = ("user", "login", "account", "client_id", "access_key_id")
_AS_HEX = bytes(ord("h") if chr(b) in "0123456789abcdef" else ord(" ") for b in range(256))

Span = tuple[int, int]


def base_spans(text: str, lower: str) -> dict[str, list[Span]]:
    """Leftmost, non-overlapping matches of each base kind; too short ones are dropped.

    The cheap tests only leave out texts in which the pattern cannot match.
    """
    found: dict[str, list[Span]] = {k: [] for k in BASE_KINDS}
    if any(w in lower for w in SECRET_WORDS):
        found["assign"] = [m.span() for m in ASSIGN.finditer(text)
                           if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found["access"] = [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    if b"h" * HEX_LENGTH in text.encode().translate(_AS_HEX):
        found["hex"] = [m.span() for m in HEX.finditer(text) if len(m[0]) >= HEX_LENGTH]
    return found


def mixed(token: str) -> bool:
    """Upper and lower case and digits, as keys have and words do not."""
    return (any(c.isdigit() for c in token) and any(c.isupper() for c in token)
            and any(c.islower() for c in token))


class Intervals:
    """Disjoint sorted spans, asked whether one of them meets an interval."""

    def __init__(self, spans: Iterable[Span]) -> None:
        merged: list[list[int]] = []
        for start, end in sorted(spans):
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(end, merged[-1][1])
            else:
                merged.append([start, end])
        self.spans = merged
        self.ends = [end for _, end in merged]

    def near(self, span: Span, reach: int) -> bool:
        """Whether one starts before the widened span ends and ends after it starts."""
        at = bisect_right(self.ends, span[0] - reach)
        return at < len(self.spans) and self.spans[at][0] < span[1] + reach

    def meets(self, span: Span) -> bool:
        return self.near(span, 0)


def linked_spans(text: str, lower: str, base: dict[str, list[Span]],
                 reach: int = REACH) -> dict[str, list[Span]]:
    """Weak parts whose complementary parts are in scope."""
    accounts = []
    if any(w in lower for w in ACCOUNT_WORDS):
        accounts = [m.span() for m in ACCOUNT.finditer(text)]
    ends = []
    if any(w in lower for w in ENDPOINT_WORDS):
        ends = [m.span() for m in ENDPOINT.finditer(text)]
    if not accounts and not base["access"] and not ends:
        return {}                          # nothing complements a secret
    strong = Intervals([*base["assign"], *base["hex"]])
    weak = [m.span() for m in UNNAMED.finditer(text) if mixed(m[0])]
    if any(w in lower for w in WEAK_WORDS):
        weak += [m.span() for m in SHORT_SECRET.finditer(text)]
    weak = [s for s in weak if not strong.meets(s)]
    held = Intervals(weak)
    others = Intervals([*base["access"], *accounts, *(s for s in ends if not held.meets(s))])
    weak = [s for s in sorted(set(weak)) if others.near(s, reach)]
    secrets = Intervals([*base["assign"], *base["hex"], *weak])
    accounts = [s for s in accounts if secrets.near(s, reach)]
    ends = [s for s in ends if secrets.near(s, reach)]
    return {"account": accounts, "weak": weak, "endpoint": ends}


def listed(spans: dict[str, list[Span]], kinds: Iterable[str] = KINDS) -> str:
    rows = sorted((start, n, end) for n, kind in enumerate(KINDS) if kind in kinds
                  for start, end in spans.get(kind, ()))
    return ",".join(f"{KINDS[n]}:{start}:{end}" for start, n, end in rows)


def scan(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with a count for each base kind, ``n_linked``, ``base_spans`` and ``spans``
    (kind:start:end, code points, end exclusive, by start)."""

    def one(value: str) -> tuple:
        lower = value.lower()
        base = base_spans(value, lower)
        linked = linked_spans(value, lower, base, reach)
        return (*(len(base[k]) for k in BASE_KINDS), sum(map(len, linked.values())),
                listed(base), listed(base | linked))

    names = ("n_assign", "n_access", "n_hex", "n_linked", "base_spans", "spans")

    def run(texts: list[str]) -> dict[str, pa.Array]:
        columns = list(zip(*map(one, texts)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds)}

    return map_texts(docs, text, "n_assign long, n_access long, n_hex long, n_linked long, "
                     "base_spans string, spans string", run)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the base spans and all spans of every document."""
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex",
                        F.sha2("base_spans", 256).alias("base_sha256"), "spans")
