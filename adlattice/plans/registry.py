"""Named queries: a Spark frame and, where SQL can say it, the same result as SQL text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from adlattice.plans.sql_views import with_views
from adlattice.plans.views import Views


@dataclass(frozen=True)
class Query:
    name: str
    covers: str
    columns: str
    build: Callable[[Views], DataFrame]
    sql: str | None = None

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(self.build(Views(spark, sf_dir)), self.columns)

    def oracle(self) -> str | None:
        return None if self.sql is None else with_views(tidy_sql(self.sql, self.columns))


def _columns(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in columns.split()]


# Sums differ in the last bits with the order of addition. The shift keeps exact halves (frequent among
# means of two-digit decimals) from rounding either way; both engines apply it.
HALF_SHIFT = 3.7e-9


def tidy(df: DataFrame, columns: str) -> DataFrame:
    """Declared columns only: ``i`` long, ``r`` double rounded to 6 digits, ``t`` text, ``b`` boolean."""
    out = []
    for name, kind in _columns(columns):
        c = F.col(f"`{name}`")
        if kind == "i":
            c = c.cast("long")
        elif kind == "r":
            c = F.round(c.cast("double") + F.lit(HALF_SHIFT), 6) + F.lit(0.0)
        elif kind == "t":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


def tidy_sql(sql: str, columns: str) -> str:
    out = []
    for name, kind in _columns(columns):
        c = {
            "i": f"CAST({name} AS BIGINT)",
            "r": f"round(CAST({name} AS DOUBLE) + CAST({HALF_SHIFT} AS DOUBLE), 6) + CAST(0 AS DOUBLE)",
            "t": f"CAST({name} AS VARCHAR)",
            "b": f"CAST({name} AS BOOLEAN)",
        }[kind]
        out.append(f"{c} AS {name}")
    return f"SELECT {', '.join(out)} FROM ({sql.strip()}) q"
