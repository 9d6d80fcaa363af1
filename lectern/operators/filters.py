"""Predicates on documents. Dates become ranges, which reach the scan."""

from __future__ import annotations

from calendar import monthrange
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import parse_day, parse_month
from lectern.operators.index import of_terms
from lectern.plans.ast import DateFilter, FilterSet


def rubrique_is(rubrique: str, column: str = "rubrique") -> Column:
    return F.lower(column) == rubrique.lower()


def date_range(wanted: DateFilter) -> tuple[date, date] | None:
    """First and last day of a date filter; null if a bound cannot be read, which matches nothing."""
    ranged = wanted.kind.startswith("between_")
    low, high = (wanted.start, wanted.end) if ranged else (wanted.value, wanted.value)
    if not low or not high:
        return None
    grain = wanted.kind.removeprefix("between_")
    if grain == "y":
        return date(int(low), 1, 1), date(int(high), 12, 31)
    if grain == "my":
        first, last = parse_month(low), parse_month(high)
        return (date(*first, 1), date(*last, monthrange(*last)[1])) if first and last else None
    first, last = parse_day(low), parse_day(high)
    return (first, last) if first and last else None


def date_matches(wanted: DateFilter, column: str = "date") -> Column:
    bounds = date_range(wanted)
    if bounds is None:
        return F.lit(False)
    day = F.col(column)
    return day.between(F.lit(bounds[0]), F.lit(bounds[1]))


def day_in(column: Column, wanted: DateFilter) -> Column:
    """As date_matches, for a timestamp column: the upper bound is the day after, exclusive."""
    bounds = date_range(wanted)
    if bounds is None:
        return F.lit(False)
    return (column >= F.lit(bounds[0]).cast("timestamp")) & (column < F.date_add(F.lit(bounds[1]), 1).cast("timestamp"))


def image_is(has_image: bool, column: str = "has_image") -> Column:
    return F.col(column) == F.lit(has_image)


def all_filters(filters: FilterSet) -> Column:
    """What a query's filters ask together; true if there are none."""
    out = F.lit(True)
    if filters.rubrique:
        out = out & rubrique_is(filters.rubrique)
    if filters.date:
        out = out & date_matches(filters.date)
    if filters.has_image is not None:
        out = out & image_is(filters.has_image)
    return F.coalesce(out, F.lit(False))


def filter_table(queries: list[tuple[str, FilterSet]]) -> list[tuple]:
    """(qid, rubrique, has_date, date_lo, date_hi, has_image) rows; has_date without bounds matches nothing."""
    out = []
    for qid, f in queries:
        bounds = date_range(f.date) if f.date else None
        out.append((qid, f.rubrique, f.date is not None, *(bounds or (None, None)), f.has_image))
    return out


FILTER_SCHEMA = "qid string, f_rubrique string, f_dated boolean, f_lo date, f_hi date, f_image boolean"


def passes_filters() -> Column:
    """On documents joined with a filter table: whether a document passes its query's filters."""
    rubrique = F.col("f_rubrique").isNull() | (F.lower("rubrique") == F.lower("f_rubrique"))
    dated = ~F.col("f_dated") | F.col("date").between(F.col("f_lo"), F.col("f_hi"))
    image = F.col("f_image").isNull() | (F.col("has_image") == F.col("f_image"))
    return F.coalesce(rubrique & dated & image, F.lit(False))


def excluded(postings: DataFrame, exclusions: DataFrame) -> DataFrame:
    """(qid, doc_id) of documents that hold an excluded term (qid, term) in any zone."""
    return of_terms(postings, exclusions).join(exclusions, "term").select("qid", "doc_id").distinct()
