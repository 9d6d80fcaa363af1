"""Text functions as Spark columns, and their plain Python counterparts for query strings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, month names and letters that decide what a token is.
WORD = r"[\p{L}\p{N}]+"
ALPHABETIC = r"^\p{L}+$"
TOKEN = r"\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d+(?:[.,]\d+)?|[A-Za-zÀ-ÖØ-öø-ÿ]+(?:-[A-Za-zÀ-ÖØ-öø-ÿ]+)*"
ENTITY = r"^(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d+(?:[.,]\d+)?)$"
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")

_TOKEN = re.compile(TOKEN, re.ASCII)
_ENTITY = re.compile(ENTITY, re.ASCII)


def strip_accents(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")


def normalize(text: str | None) -> str:
    """Without accents, case-folded, with single blanks; null is empty."""
    return " ".join(strip_accents(text).casefold().split()) if text else ""


def _each(one: Callable[[str | None], str], text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: one(t) if t is not None else None)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    # else Spark repeats it in filters, and drops a distinct() below it as redundant, so that it runs on every token
    return F.pandas_udf(run, "string").asNondeterministic()(text)


def without_accents(text: Column) -> Column:
    return _each(strip_accents, text)


def normalized(text: Column) -> Column:
    """Meant for distinct terms, which are few against the texts they come from. Null is empty."""
    return _each(normalize, F.coalesce(text, F.lit("")))


def words(text: Column) -> Column:
    """All runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def surfaces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), 0)


def counted(items: Column, name: str = "term") -> Column:
    """Distinct entries of an array and how often it has each (name, tf), by sorting it within its row."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        first = F.filter(places, lambda k: (k == 0) | (F.get(ordered, k) != F.get(ordered, k - 1)))

        def of(starts: Column) -> Column:  # bound once, as the only entry of an array
            return F.transform(starts, lambda at, k: F.struct(F.get(ordered, at).alias(name), (F.coalesce(F.get(starts, k + 1), n) - at).cast("long").alias("tf")))

        return F.flatten(F.transform(F.array(first), of))

    return F.flatten(F.transform(F.array(F.sort_array(items)), runs))


def is_alphabetic(token: Column) -> Column:
    return token.rlike(ALPHABETIC)


def query_tokens(text: Column) -> Column:
    """Dates, numbers and hyphenated words; an apostrophe of either kind ends a word."""
    return F.regexp_extract_all(F.translate(text, "’", "'"), F.lit(TOKEN), 0)


def tokenize(text: str) -> list[str]:
    return [surface for surface, _, _ in token_spans(text)]


def token_spans(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], *m.span()) for m in _TOKEN.finditer(text.replace("’", "'"))]


def spans(text: Column) -> Column:
    """Query tokens with where they begin and end, in characters."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"token": w, "start": a, "end": b} for w, a, b in token_spans(t or "")])

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<struct<token:string,start:int,end:int>>")(F.coalesce(text, F.lit("")))


def is_entity(token: Column) -> Column:
    return token.rlike(ENTITY)


def is_entity_text(token: str) -> bool:
    return _ENTITY.match(token) is not None


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix; 0 if either is empty."""
    shorter = F.least(F.length(a), F.length(b))
    upto = F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(upto, lambda n: F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n)))


def common_prefix_text(a: str, b: str) -> int:
    same = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        same += 1
    return same


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Insertions, deletions and replacements; most + 1 as soon as more than most are needed."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
        if most is not None and min(row) > most:
            return most + 1
    return row[-1]


def tfidf(tf: Column, idf: Column) -> Column:
    return F.when(idf != 0, (F.lit(1.0) + F.log10(tf)) * idf).otherwise(F.lit(0.0))


def idf(df: Column, n: Column) -> Column:
    return F.log10(n / df)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def other_lines(text: Column) -> Column:
    return F.when(F.instr(text, "\n") > 0, text.substr(F.instr(text, "\n") + 1, F.length(text))).otherwise(F.lit(""))


# ---- dates in query strings

_NUMERIC = re.compile(r"(\d{1,2})([/\- ])(\d{1,2})\2(\d{4})", re.ASCII)
_NUMERIC_MONTH = re.compile(r"(\d{1,2})[/\- ](\d{4})", re.ASCII)
_NAMED = re.compile(r"(?:(\d{1,2})\s+)?([^\W\d_]+)\s+(\d{4})")


def _month(name: str) -> int | None:
    return MONTHS.index(name.lower()) + 1 if name.lower() in MONTHS else None


def parse_day(text: str) -> date | None:
    """d/m/Y with one kind of separator, or d month Y with the French name; null if there is no such day."""
    text = text.strip()
    if m := _NUMERIC.fullmatch(text):
        parts = int(m[4]), int(m[3]), int(m[1])
    elif (m := _NAMED.match(text)) and m[1] and _month(m[2]):
        parts = int(m[3]), _month(m[2]), int(m[1])
    else:
        return None
    try:
        return date(*parts)
    except ValueError:
        return None


def parse_month(text: str) -> tuple[int, int] | None:
    """(year, month) of m/Y or of the French name and Y."""
    text = text.strip()
    if m := _NUMERIC_MONTH.fullmatch(text):
        return (int(m[2]), int(m[1])) if 1 <= int(m[1]) <= 12 and int(m[2]) else None
    m = _NAMED.match(text)
    return (int(m[3]), _month(m[2])) if m and not m[1] and _month(m[2]) else None
