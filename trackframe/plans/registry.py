"""All queries by name, and their SQL. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.plans.fixtures import fx, with_fixtures

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, *inputs: str):
    """Registers a function of fixtures under a name; sql names the same fixtures."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(*[fx(spark, sf_dir, i) for i in inputs]))
        if sql:
            ORACLE[name] = oracle(sql)
        return fn

    return add


def oracle(sql: str) -> str:
    return with_fixtures(_rounded_sql(sql))


def _rounded_sql(sql: str) -> str:
    """The last SELECT is the result; r(x) in it stands for a rounded double, i(x) for a BIGINT."""
    out = sql
    for mark, head, tail in (("r(", "(round(", ", 6) + 0.0::DOUBLE)"), ("i(", "CAST(", " AS BIGINT)")):
        at = 0
        while (at := _find(out, mark, at)) >= 0:
            depth, j = 1, at + 2
            while depth:
                depth += (out[j] == "(") - (out[j] == ")")
                j += 1
            out = out[:at] + head + out[at + 2 : j - 1] + tail + out[j:]
    return out


def _find(text: str, mark: str, start: int) -> int:
    at = text.find(mark, start)
    while at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_"):
        at = text.find(mark, at + 1)
    return at


from trackframe.plans import queries as _queries  # noqa: E402, F401
