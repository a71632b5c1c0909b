"""Column expressions and vectorised functions on plain text."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# The patterns of dates, in the order in which they're tried.
MONTH = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
DAY = "01|02|03|04|05|06|07|08|09|10|11|12|13|14|15|16|17|18|19|20|21|22|23|24|25|26|27|28|29|30|31|1|2|3|4|5|6|7|8|9"
HOUR_24 = "00|01|02|03|04|05|06|07|08|09|10|11|12|13|14|15|16|17|18|19|20|21|22|23|0|1|2|3|4|5|6|7|8|9"
HOUR_12 = "00|01|02|03|04|05|06|07|08|09|10|11|12|1|2|3|4|5|6|7|8|9"
AM_PM = r"a\.m\.|p\.m\.|am|pm"
DATE_PATTERNS = (
    ("DAY_NUM_OPTWORD_MONTH", f"({DAY})(st|nd|rd|th)? (of )?({MONTH})"),
    ("MONTH_DAY_NUM_WORD", f"({MONTH}) ({DAY})(st|nd|rd|th)"),
    ("MONTH_YEAR", f"({MONTH}) (2010|2011|2012|2013|2014|2015|2016|2017|2018|2019|2020|2021|2022|2023|2024)"),
    ("TIME", rf"(({HOUR_24})(:|\.)(0|1|2|3|4|5)(0|5)\s?({AM_PM})?|({HOUR_12})\s?({AM_PM}))"),
    ("DAY_NAME", "(monday|tuesday|wednesday|thursday|friday|saturday|sunday|mon|tue|wed|thu|thur|thurs|fri|sat|sun)"),
)
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
#: Shorter patterns that are found in a text exactly if those are.
DATE_FOUND = (
    ("DAY_NUM_OPTWORD_MONTH", "(?:[1-9]|[123]0)(?:st|nd|rd|th)? (?:of )?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"),
    ("MONTH_DAY_NUM_WORD", f"(?:{_MONTHS}) (?:0[1-9]|[12][0-9]|3[01]|[1-9])(?:st|nd|rd|th)"),
    ("MONTH_YEAR", f"(?:{_MONTHS}) 20(?:1[0-9]|2[0-4])"),
    ("TIME", r"[0-9](?:[:.][0-5][05]|(?:(?<=[1-9])|(?<=[01]0))\s?[ap](?:m|\.m\.))"),
    ("DAY_NAME", "mon|tue|wed|thu|fri|sat|sun"),
)
MORE_TEXTS = ("more", "read more", "learn more", "see more", "view more", "find out more", "more info", "details", "continue reading")


def text_is_digit(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"^\p{Nd}+$")), F.lit(False))


def text_has_date(text: Column) -> Column:
    """The label of the first pattern found anywhere in the text, '' if none is."""
    label = F.lit("")
    for name, pattern in reversed(DATE_FOUND):
        label = F.when(F.rlike(text, F.lit(f"(?i){pattern}")), name).otherwise(label)
    return label


def text_is_more_link(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"\s*(…|»|\.\.\.)$", "").isin(*MORE_TEXTS)


def quick_distance(a: Column, b: Column) -> Column:
    """1 - 2 * shared characters / all characters, characters as a multiset; 0 if both are empty."""

    def times(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c, F.lit("")))

    letters = F.filter(F.array_distinct(F.split(a, "")), lambda c: c != "")
    shared = F.aggregate(letters, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    size = F.length(a) + F.length(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.lit(2.0) * shared / size)


def simple_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance by the longer length; 0 if both are empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest.cast("double"))


@F.pandas_udf(DoubleType())
def gestalt_percent(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp similarity, 0 to 100; equal pairs of a batch are compared once."""
    known: dict[tuple, float | None] = {}
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = None if pair[0] is None or pair[1] is None else float(int(100 * SequenceMatcher(None, *pair, autojunk=False).ratio()))
    return pd.Series([known[p] for p in zip(a, b)], dtype="float64")


def blended_distance(forward: Column, backward: Column, levenshtein: Column, quick: bool) -> Column:
    """The distance of two strings from their gestalt distances (forward and reversed) and edit distance."""
    if quick:
        return forward
    mixed = F.lit(0.34) * levenshtein + F.lit(0.33) * forward + F.lit(0.33) * backward
    low, high = F.least(forward, backward, levenshtein), F.greatest(forward, backward, levenshtein)
    final = F.when(mixed < 0.15, F.lit(0.6) * mixed + F.lit(0.4) * low).when(mixed > 0.85, F.lit(0.6) * mixed + F.lit(0.4) * high).otherwise(mixed)
    return F.when(forward < 0.3, forward).when(F.abs(forward - backward) <= 0.19, (forward + backward) / 2).otherwise(final)
