"""Trimming, substring rules and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sift.functions.needles import any_of, listed, positions

# ---- fixed values: every code point that counts as outer white space ----------
WHITESPACE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# -------------------------------------------------------------------------------

# A few needles are unrolled, which is fastest; longer lists are found in one pass by a
# common pattern, as a generated method of many needles outgrows what the JVM compiles.
UNROLL_LIMIT = 12


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def contains_any(text: Column, needles: Sequence[str]) -> Column:
    """True if any needle occurs in the text as a plain substring."""
    if not needles:
        return F.lit(False)
    if len(needles) > UNROLL_LIMIT:
        return F.rlike(text, F.lit(any_of(needles)))
    return reduce(or_, [F.contains(text, F.lit(n)) for n in needles])


def first_contained(text: Column, needles: Sequence[str]) -> Column:
    """The first needle, in list order, that occurs in the text; else NULL."""
    if not needles:
        return F.lit(None).cast("string")
    if len(needles) > UNROLL_LIMIT:
        return F.get(listed(needles), F.get(positions(text, needles), F.lit(0)))
    return F.coalesce(*[F.when(F.contains(text, F.lit(n)), F.lit(n)) for n in needles])


def fingerprint(source: Column, company: Column, url: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the case-folded posting key."""
    key = F.concat_ws("|", *[blank_if_null(c) for c in (source, company, url)])
    return F.substring(F.sha2(F.lower(strip(key)), 256), 1, 16)
