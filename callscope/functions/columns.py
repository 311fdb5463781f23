"""Column expressions shared by the operators. All are built-in Spark functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import Window
from pyspark.sql import functions as F


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


# --- coercion -----------------------------------------------------------------


def to_timestamp_or_null(c) -> Column:
    """ISO-8601 text (or a timestamp) to timestamp; anything else to NULL."""
    return as_col(c).try_cast("timestamp")


def to_double_or_null(c) -> Column:
    """Number text to double; text that is no number, NaN and infinities become NULL."""
    number = as_col(c).try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def parse_flag(c) -> Column:
    """Tolerant boolean: true/t/1 and false/f/0 in any case; anything else is NULL."""
    text = F.lower(F.trim(as_col(c).cast("string")))
    return (
        F.when(text.isin("true", "t", "1", "1.0"), F.lit(True))
        .when(text.isin("false", "f", "0", "0.0"), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def blank_to_null(c) -> Column:
    return F.nullif(as_col(c), F.lit(""))


def null_to_blank(c) -> Column:
    return F.coalesce(as_col(c).cast("string"), F.lit(""))


def clean_method(c) -> Column:
    return F.upper(F.trim(null_to_blank(c)))


# --- status classes -----------------------------------------------------------


def is_success(status="status_code", blocked="blocked") -> Column:
    return as_col(status).between(200, 399) & ~as_col(blocked)


def is_error(status="status_code") -> Column:
    return as_col(status) >= 400


def is_server_error(status="status_code") -> Column:
    return as_col(status).between(500, 599)


def ratio(part, whole) -> Column:
    """part / whole as double, 0 when the denominator is 0."""
    part, whole = as_col(part), as_col(whole)
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


# --- time ---------------------------------------------------------------------


def minute_of(c) -> Column:
    return F.date_trunc("minute", as_col(c))


def time_text(c) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text used at the query surface."""
    return F.date_format(as_col(c), "yyyy-MM-dd HH:mm:ss")


def iso_minute(c) -> Column:
    return F.date_format(as_col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_hour(c) -> Column:
    return F.date_format(F.date_trunc("hour", as_col(c)), "yyyy-MM-dd'T'HH:00:00'Z'")


# --- vectors ------------------------------------------------------------------


def as_doubles(c) -> Column:
    return as_col(c).cast("array<double>")


def dot(a, b) -> Column:
    """Dot product; a missing vector counts as zeros, the shorter length wins."""
    pairs = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y)
    total = F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    return F.coalesce(total, F.lit(0.0))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(as_doubles(a), F.lit(0.0), lambda acc, v: acc + v * v))


def cosine(a, b) -> Column:
    """Cosine similarity, NULL unless both vectors are valid and equally long."""
    size = norm(a) * norm(b)
    fits = (F.size(as_col(a)) == F.size(as_col(b))) & (size > 0)
    return F.when(fits, dot(a, b) / size)


def vector_problem(c, dimension: int | None = None) -> Column:
    """Why a vector cannot be used for cosine similarity, or NULL if it can."""
    v = as_doubles(c)
    finite = F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    )
    reason = F.when(v.isNull() | (F.size(v) < 1), "empty")
    if dimension is not None:
        reason = reason.when(F.size(v) != dimension, "dimension")
    return reason.when(~finite, "not finite").when(norm(c) == 0, "zero norm")


# --- rows ---------------------------------------------------------------------


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def null_safe_equal(left, right, names) -> Column:
    return all_of(left[n].eqNullSafe(right[n]) for n in names)


def top_n_per_group(df, keys, order, n: int, *, salt_by, salts: int = 32, rank: str = "rank"):
    """First ``n`` rows of every group in two steps, so that a hot group never sorts whole.

    The inner rank is taken per salted sub-group and Spark turns ``rank <= n`` into a
    limit below the shuffle; the outer rank sees at most ``salts * n`` rows per group.
    ``order`` must be a full order for the result to be unique; ``salt_by`` names columns
    that differ between the rows of a group.
    """
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts))
    inner = Window.partitionBy(*keys, "_salt").orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn(rank, F.row_number().over(inner))
        .where(F.col(rank) <= n)
        .drop("_salt", rank)
        .withColumn(rank, F.row_number().over(outer))
        .where(F.col(rank) <= n)
    )

