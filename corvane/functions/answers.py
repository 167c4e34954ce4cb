"""Column expressions over answers and their sources: citations, confidence, display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import preview

#: Weights of mean, consistency, share of high scores and number of results; limits of the levels.
WEIGHTS = {"mean": 0.4, "consistency": 0.3, "high": 0.2, "count": 0.1}
SPREAD, HIGH_SCORE, ENOUGH_RESULTS = 0.5, 0.5, 10
LOW_BELOW, MEDIUM_BELOW = 0.5, 0.75


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def citations(answer: str | Column) -> Column:
    """Distinct numbers cited as ``[n]`` (ASCII digits), in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(_c(answer), F.lit("")), F.lit(r"\[([0-9]{1,9})\]"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def invalid_citations(answer: str | Column, n_sources: str | Column) -> Column:
    return F.filter(citations(answer), lambda n: (n < 1) | (n > _c(n_sources)))


def citation_warnings(answer: str | Column, n_sources: str | Column) -> Column:
    """A warning for each cited number without a source."""
    return F.transform(invalid_citations(answer, n_sources), lambda n: F.format_string("citation [%d] has no source; there are %d", n, _c(n_sources).cast("int")))


def is_cited(answer: str | Column, number: str | Column) -> Column:
    return F.array_contains(citations(answer), _c(number).cast("int"))


def confidence_of(mean: Column, spread: Column, high: Column, count: Column) -> Column:
    """Confidence in 0..1 from aggregates of the scores; 0 without results."""
    consistency = F.when(count <= 1, F.lit(1.0)).otherwise(1 - F.least(spread / SPREAD, F.lit(1.0)))
    total = WEIGHTS["mean"] * mean + WEIGHTS["consistency"] * consistency + WEIGHTS["high"] * high + WEIGHTS["count"] * F.least(count / ENOUGH_RESULTS, F.lit(1.0))
    return F.when(count == 0, F.lit(0.0)).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def confidence_aggregate(score: str | Column = "score", high_score: float = HIGH_SCORE) -> Column:
    """The aggregate that gives a group's confidence."""
    s = _c(score).cast("double")
    return F.coalesce(confidence_of(F.avg(s), F.stddev_pop(s), F.avg((s >= high_score).cast("double")), F.count(s)), F.lit(0.0))


def confidence_level(confidence: str | Column) -> Column:
    return F.when(_c(confidence) < LOW_BELOW, "Low").when(_c(confidence) < MEDIUM_BELOW, "Medium").otherwise("High")


def confidence_explanation(confidence: str | Column, n_sources: str | Column) -> Column:
    percent = F.format_string("%.0f%%", _c(confidence) * 100)
    what = (
        F.when(_c(confidence) < LOW_BELOW, "the sources match the question poorly or disagree; check the answer")
        .when(_c(confidence) < MEDIUM_BELOW, "the sources match the question in part")
        .otherwise("the sources match the question well and agree")
    )
    return F.concat(confidence_level(confidence), F.lit(" confidence ("), percent, F.lit(", "), _c(n_sources).cast("string"), F.lit(" sources): "), what)


def source_line(number: str | Column, doc_id: str | Column, score: str | Column, text: str | Column, cited: str | Column, length: int = 150) -> Column:
    mark = F.when(_c(cited), "✓").otherwise(" ")
    return F.concat(mark, F.lit(" ["), _c(number).cast("string"), F.lit("] "), _c(doc_id), F.lit(" (score "), F.format_string("%.2f", _c(score).cast("double")), F.lit("): "), preview(text, length))
