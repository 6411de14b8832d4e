"""Text as Column expressions: normal form, folding, counting, clipping."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python knows it.
WS = "\\t-\\r\\x1c-\\x20\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that fold to one other character though lower() keeps them or depends on the context.
_FROM = "µſͅϐϑϕϖϰϱϵςẛι"
_TO = "μsιβθφπκρεσṡι"
#: Terms of fewer characters are matched without an index of trigrams and without a rank.
SHORT = 3


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def composed(c: Column) -> Column:
    """NFC; Python only gets what isn't ASCII."""
    return F.coalesce(_nfc(F.when(c.rlike("[^\\x00-\\x7f]"), c)), c)


def normalize_text(c: Column, compose: bool = True) -> Column:
    """NFC, one kind of line end, no blanks at the ends of lines nor around the whole. compose=False: c is in NFC already."""
    if compose:
        c = composed(c)
    c = F.regexp_replace(c, "\\r\\n?", "\n")
    c = F.regexp_replace(c, f"[{WS}&&[^\\n]]+(?=\\n|\\z)", "")
    return F.regexp_replace(c, f"\\A[{WS}]+|[{WS}]+\\z", "")


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def ascii_fold(c: Column) -> Column:
    return F.when(_ascii(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fold(c: Column) -> Column:
    """Case folded one character to one character, accents kept. translate, which is slow, only runs where it changes something."""
    low = F.lower(F.replace(c, F.lit("İ"), F.lit("")))
    return F.when(_ascii(low) | ~low.rlike(f"[{_FROM}]"), low).otherwise(F.translate(low, _FROM, _TO))


def fold_term(term: str) -> str:
    """What fold() makes of a term; for the driver's side."""
    low = "".join(x.lower() if len(x.lower()) == 1 and x != "İ" else "" if x == "İ" else x for x in term)
    return low.translate(str.maketrans(_FROM, _TO))


def occurrences(c: Column, term: str) -> Column:
    """Overlapping occurrences of a literal term. One that can't overlap itself is counted by what its removal leaves."""
    if term and not any(term.startswith(term[i:]) for i in range(1, len(term))):
        return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(term), F.lit("")))) / len(term.encode())).cast("int")
    quoted = "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return F.regexp_count(c, F.lit(f"(?={quoted})"))


def split_terms(query: str) -> tuple[list[str], list[str]]:
    """Long terms and short terms, in order, repeats included."""
    terms = query.split()
    return [t for t in terms if len(t) >= SHORT], [t for t in terms if len(t) < SHORT]


def estimate_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.shiftright(F.length(c) + 3, 2))


def clip(c: Column, most: Column | int) -> Column:
    most = F.lit(most) if isinstance(most, int) else most
    head = F.regexp_replace(F.substring(c, F.lit(1), F.greatest(F.lit(0), most - 20)), f"[{WS}]+\\z", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(head, F.lit("\n[truncated]")))


def preview(c: Column) -> Column:
    flat = F.regexp_replace(c, "\n", " ")
    return F.when(F.length(flat) > 300, F.concat(F.substring(flat, 1, 297), F.lit("..."))).otherwise(flat)


def turn_text(human: Column, assistant: Column) -> Column:
    return F.concat_ws("\n\n", F.nullif(human, F.lit("")), F.nullif(assistant, F.lit("")))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def stable_json(c: Column) -> Column:
    """to_json, with escapes of control characters as other writers spell them."""
    j = F.to_json(c)
    for i in range(0x1A, 0x20):
        j = F.replace(j, F.lit(f"\\u00{i:02X}"), F.lit(f"\\u00{i:02x}"))
    for x in "BEF":
        j = F.replace(j, F.lit(f"\\u000{x}"), F.lit(f"\\u000{x.lower()}"))
    return j
