"""Scalar expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits, split where camel case begins a word, in lower case."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z0-9])([A-Z])|([A-Z]+)([A-Z][a-z])", "$1$3 $2$4")
    return F.transform(F.filter(F.split(spaced, "[^a-zA-Z0-9]+"), lambda x: x != ""), F.lower)


def tokens_match(text: Column, term: Column) -> Column:
    """A contiguous run of text tokens matches all term tokens; of two tokens, either may be a prefix of the other."""
    starts = F.sequence(F.lit(0), F.size(text) - F.size(term))
    hit = F.exists(starts, lambda s: F.forall(F.sequence(F.lit(0), F.size(term) - 1), lambda i: _prefix_either(
        F.get(text, s + i), F.get(term, i))))
    return F.when((F.size(term) > 0) & (F.size(text) >= F.size(term)), hit).otherwise(False)


def _prefix_either(a: Column, b: Column) -> Column:
    return F.startswith(a, b) | F.startswith(b, a)


def waiver_expired(expires: Column, now: Column) -> Column:
    """Missing or unreadable expiry never expires."""
    return F.coalesce(F.try_to_timestamp(expires) <= now, F.lit(False))


def disposition_active(mode: Column, expires: Column, now: Column) -> Column:
    """A waiver without a readable, later expiry is not active; other modes always are."""
    return F.when(mode == "waive", F.coalesce(F.try_to_timestamp(expires) > now, F.lit(False))).otherwise(True)


def path_params(c: Column) -> Column:
    """Names of {x} and :x in a route path, in order."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"(\{[A-Za-z0-9_]+\}|:[A-Za-z0-9_]+)"), F.lit(1)), lambda p: F.regexp_replace(p, r"[{}:]", "")), lambda p: p != "")


def shape_hash(*cols: Column) -> Column:
    """sha256 of the values, nulls told apart from empty strings."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in cols)), 256)


def csv_field(c: Column) -> Column:
    """A CSV field: quoted only for a double quote, comma, CR or LF; null is empty."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike('["\n\r,]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def csv_record(*cols: Column) -> Column:
    """A CSV record without its line end."""
    return F.concat_ws(",", *map(csv_field, cols))
