"""Registry of the named queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``, with SQL of the same result if there is one."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = same_cut(sql)
        return fn

    return register


NUDGE = 0.501


def rounded(df: DataFrame, cols: list[str] | None = None, places: int = 8) -> DataFrame:
    """Round doubles once at the very end: sums differ in the last bits by engine.

    Means of two-decimal readings often sit on a decimal tie, where the last bit would
    decide; the cut is therefore placed slightly beside the tie, by the same arithmetic
    in Spark and in SQL (see ``same_cut``).
    """
    names = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    scale = F.lit(float(10**places))
    return df.withColumns({c: F.floor(F.col(c) * scale + NUDGE).cast("double") / scale for c in names})


def same_cut(text: str) -> str:
    """``round(x, n)`` with n >= 6 in SQL text, spelled out as ``rounded`` does it."""
    out, at = "", 0
    while True:
        start = text.find("round(", at)
        if start < 0:
            return out + text[at:]
        depth, comma, i = 0, -1, start + 6
        while depth >= 0:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            if text[i] == "," and depth == 0:
                comma = i
            i += 1
        inner, places = same_cut(text[start + 6 : comma]), int(text[comma + 1 : i - 1])
        if places < 6:
            cut = f"round({inner}, {places})"
        else:
            scale = f"CAST({10**places} AS DOUBLE)"
            cut = f"(CAST(floor(({inner}) * {scale} + CAST({NUDGE} AS DOUBLE)) AS DOUBLE) / {scale})"
        out += text[at:start] + cut
        at = i
