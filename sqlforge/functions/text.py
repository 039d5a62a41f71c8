"""Column functions over SQL and free text (all native Spark expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import SCHEMA_STOPWORDS, WORD_RE

# Whitespace as Python's str.strip() sees it (ASCII and the Unicode spaces).
PY_WS = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda variable is computed once per row).

    Without it, an intermediate array referenced several times, or inside a
    lambda, is re-inlined into every reference and recomputed each time.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


# The same whitespace as a plain character set, for trim (no regex).
PY_WS_CHARS = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "\u2028\u2029\u202f\u205f\u3000")


def py_strip(c) -> Column:
    """Strip leading/trailing whitespace like ``str.strip()`` (plain ``trim`` only removes spaces)."""
    return F.trim(_c(c), F.lit(PY_WS_CHARS))


def rstrip_chars(c, chars: str) -> Column:
    """``str.rstrip(chars)`` for a set of literal characters."""
    import re
    return F.regexp_replace(_c(c), "[" + re.escape(chars) + "]+$", "")


def normalize_sql(c) -> Column:
    """Strip, drop trailing ';', lower, collapse whitespace, no space after '(' / before ')'."""
    s = F.lower(rstrip_chars(py_strip(c), ";"))
    s = F.regexp_replace(s, rf"{PY_WS}+", " ")
    s = F.regexp_replace(s, r"\(" + PY_WS + "+", "(")
    s = F.regexp_replace(s, PY_WS + r"+\)", ")")
    return py_strip(s)


def words(c, lower: bool = True) -> Column:
    """Word tokens (Unicode letters, digits, underscore) as an array."""
    s = F.lower(_c(c)) if lower else _c(c)
    return F.regexp_extract_all(s, F.lit(WORD_RE), 0)


def whitespace_tokens(c) -> Column:
    """``str(x).lower().split()``: whitespace separated tokens; NULL counts as 'none'."""
    return F.regexp_extract_all(F.coalesce(F.lower(_c(c)), F.lit("none")), F.lit(r"\S+"), 0)


def schema_tokens(c) -> Column:
    """Distinct identifiers of two or more characters outside quoted text, minus keywords."""
    s = F.lower(_c(c))
    s = F.regexp_replace(s, r"'[^']*'", "")
    s = F.regexp_replace(s, r'"[^"]*"', "")
    toks = F.array_distinct(F.regexp_extract_all(s, F.lit(r"\b[a-z_][a-z0-9_]{1,}\b"), 0))
    return F.array_except(toks, F.array(*[F.lit(k) for k in SCHEMA_STOPWORDS]))


def ngrams(c, n: int = 2) -> Column:
    """Word n-grams of the lower-cased text, each joined by a space; empty when too short."""
    def grams(toks):
        g = F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.array_join(F.slice(toks, i, n), " "))
        return F.when(F.size(toks) >= n, g).otherwise(F.array().cast("array<string>"))
    return let(words(c), grams)


def has_order_by(c) -> Column:
    """Plain substring test for 'order by' in the lower-cased SQL (Q10)."""
    return F.lower(_c(c)).contains("order by")
