"""Column expressions over ``array<float>`` vectors; sums are in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "dot", "euclidean")


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return metric


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def same_size(a: str | Column, b: str | Column) -> Column:
    """Null where the vectors have one dimension, else the query fails."""
    a, b = _c(a), _c(b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in dimension")))


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: str | Column) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: str | Column, b: str | Column, assume_normalized: bool = False, strict: bool = True) -> Column:
    """Cosine; a zero vector raises, or gives null if not ``strict``. Unit vectors can skip the norms."""
    if assume_normalized:
        return dot(a, b)
    length = norm(a) * norm(b)
    zero = F.raise_error(F.lit("cosine of a zero vector")).cast("double") if strict else F.lit(None).cast("double")
    return F.when(length == 0, zero).otherwise(dot(a, b) / length)


def cosine_distance(a: str | Column, b: str | Column, **options) -> Column:
    return 1 - cosine_similarity(a, b, **options)


def euclidean_distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def normalize(a: str | Column) -> Column:
    """The unit vector; zero vectors stay as they are."""
    n = norm(a)
    return F.transform(_c(a), lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))


def score(a: str | Column, b: str | Column, metric: str = "cosine", assume_normalized: bool = False) -> Column:
    """Larger is nearer for every metric: cosine, dot product or minus the Euclidean distance."""
    check_metric(metric)
    if metric == "cosine":
        return cosine_similarity(a, b, assume_normalized)
    return dot(a, b) if metric == "dot" else -euclidean_distance(a, b)


def score_to_distance(s: str | Column, metric: str) -> Column:
    return 1 - _c(s) if check_metric(metric) == "cosine" else -_c(s)


def distance_to_score(d: str | Column, metric: str) -> Column:
    return 1 - _c(d) if check_metric(metric) == "cosine" else -_c(d)


def valid_score(s: str | Column, metric: str, slack: float = 1e-6) -> Column:
    """Whether a similarity lies in its metric's range; ``slack`` allows for rounding."""
    if check_metric(metric) == "cosine":
        return _c(s).between(-1 - slack, 1 + slack)
    return F.lit(True) if metric == "dot" else _c(s) <= slack


def checked_vector(v: str | Column, dimension: int) -> Column:
    """The vector, or an error where its dimension is another."""
    wrong = F.raise_error(F.concat(F.lit(f"expected dimension {dimension}, got "), F.size(_c(v)).cast("string")))
    return F.when(F.size(_c(v)) == dimension, _c(v)).otherwise(wrong.cast("array<float>"))
