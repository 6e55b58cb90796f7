"""Predicates over records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Conditions that all must hold; an empty one is none. Texts match as substrings, literally, whatever the case."""

    source: str = ""
    location: str = ""
    title: str = ""
    job_type: str = ""
    date_after: str | None = None


def both(*conditions: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def has(column: str, text: str) -> Column | None:
    return F.coalesce(F.lower(column).contains(text.lower()), F.lit(False)) if text else None


def matches(f: Filters, *, active: bool = True, vectors: str | None = None, exact_source: bool = True) -> Column:
    """One predicate for a Filters; vectors names the model that an embedding must come from."""
    source = None
    if f.source:
        source = F.col("source") == f.source if exact_source else has("source", f.source)
    return both(
        F.col("is_active") if active else None,
        F.col("embedding_model").eqNullSafe(vectors) & F.col("embedding").isNotNull() if vectors else None,
        source,
        has("location", f.location),
        has("title", f.title),
        has("job_type", f.job_type),
        F.col("date_posted") >= F.lit(f.date_after).cast("date") if f.date_after else None,
    )


def any_has(text: str, *columns: str) -> Column:
    """Whether some column contains the text."""
    return reduce(lambda a, b: a | b, [has(c, text) for c in columns])


def pending(model: str, provider: str) -> Column:
    """Chunks without a vector of this model."""
    return F.col("embedding").isNull() | ~F.col("embedding_model").eqNullSafe(model) | ~F.col("embedding_provider").eqNullSafe(provider)


def attempts_left(manual: bool = False, most: int = 3) -> Column:
    return F.col("embedding_attempts") > 0 if manual else F.col("embedding_attempts") < most


def stale(as_of: Column, days: int = 60, posted: str = "date_posted", seen: str = "last_seen_at") -> Column:
    """Posted before the cutoff; without a date, last seen before it."""
    cutoff = F.date_sub(as_of, days)
    return F.coalesce(F.col(posted) < cutoff, F.col(seen) < cutoff.cast("timestamp"), F.lit(False))


def no_text(column: str) -> Column:
    return F.coalesce(F.length(F.trim(column)) == 0, F.lit(True))
