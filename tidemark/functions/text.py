"""Text expressions."""

from __future__ import annotations

from collections.abc import Iterable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import settings

# (?U) makes \s and \S cover all Unicode white space.
_SPACE = r"(?U)\s+"
_WORD = r"(?U)\S+"

# Character references: decimal, hexadecimal, or one of HTML's names.
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,9});"
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'"}


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for a missing text."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0))


def long_enough(text: Column, min_words: int = settings.MIN_FILING_WORDS) -> Column:
    """At least ``min_words`` words; stops reading a text once that many are seen."""
    if min_words < 1:
        return text.isNotNull()
    pattern = rf"(?U)\A\s*+(?:\S++\s++){{{min_words - 1}}}\S"
    return F.coalesce(text.rlike(pattern), F.lit(False))


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def only(token_array: str, terms: Iterable[str]) -> str:
    """SQL text: the tokens that are in ``terms``, repeats included."""
    quoted = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in terms)
    return f"filter({token_array}, t -> t in ({quoted}))"


def character(code: Column) -> Column:
    """The character of a code point; the replacement character where there is none."""
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    point = F.when(valid, code).otherwise(0xFFFD)
    return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")


def decode_references(text: Column) -> Column:
    """Character references replaced, each once, so that ``&amp;lt;`` becomes ``&lt;``.

    What is no reference, or an unknown name, stays as it is.
    """
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def piece(part: Column) -> Column:
        reference = F.regexp_extract(part, _REFERENCE, 1)
        base = F.when(F.lower(F.substring(reference, 2, 1)) == "x", 16).otherwise(10)
        digits = F.regexp_replace(reference, "^#[xX]?", "")
        number = F.when(base == 16, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        value = (F.when(reference == "", F.lit(None))
                 .when(F.startswith(reference, F.lit("#")), character(number))
                 .otherwise(F.try_element_at(names, reference)))
        rest = F.substring(part, F.length(reference) + 2, F.length(part))
        return F.coalesce(F.concat(value, rest), F.concat(F.lit("&"), part))

    parts = F.split(text, "&", -1)
    later = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece)
    return F.when(F.contains(text, F.lit("&")), F.concat(
        F.element_at(parts, 1), F.array_join(later, ""))).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags, references decoded, single
    spaces.  An unclosed script or style reaches to the end."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(decode_references(out), _SPACE, " "))


def chunks(token_array: str, size: int = settings.CHUNK_TOKENS) -> str:
    """SQL text: the token array cut into consecutive pieces of ``size``, the last maybe shorter."""
    pieces = f"cast(ceil(size({token_array}) / {size}) as int)"
    starts = f"if({pieces} > 0, sequence(0, {pieces} - 1), cast(array() as array<int>))"
    return f"transform({starts}, i -> slice({token_array}, i * {size} + 1, {size}))"


def zero_padded(number: Column, width: int = 10) -> Column:
    """Left-pad with zeros but never cut, unlike ``lpad``."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))
