"""Where matches go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_matches(matches: DataFrame, path: str, column: str = "value", mode: str = "errorifexists", order_by: list[str] | None = None) -> None:
    """Text files with a match a line. order_by sorts all matches, which shuffles them; else documents keep their order."""
    if order_by:
        matches = matches.orderBy(*order_by)
    matches.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def discard(matches: DataFrame) -> None:
    """Computes all matches and keeps none."""
    matches.write.format("noop").mode("overwrite").save()


def collect(matches: DataFrame, column: str = "value") -> list:
    """The matches on the driver, which must hold them."""
    return [r[0] for r in matches.select(column).collect()]
