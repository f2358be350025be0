"""Registration of a query together with its SQL twin."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duowave.checks.views import Tables, common_table_expressions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: Sequence[str] = (), digits: int = 6):
    """Register a function of ``Tables``; the columns in ``doubles`` are rounded on both sides.

    ``{step}`` in the SQL refers to a view or step, whose definition is put in front.
    """
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(Tables(spark, folder))
            return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in doubles}) if doubles else df

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = _twin(sql, doubles, digits)
        return fn

    return register


def _twin(sql: str, doubles: Sequence[str], digits: int) -> str:
    steps = common_table_expressions(re.findall(r"\{(\w+)\}", sql))
    body = re.sub(r"\{(\w+)\}", r"\1", sql).strip()
    if steps:
        text = f"WITH RECURSIVE {steps}{body}" if body.startswith(",") else f"WITH RECURSIVE {steps}\n{body}"
    else:
        text = f"WITH RECURSIVE {body.lstrip(',')}" if body.startswith(",") else body
    if not doubles:
        return text
    rounded = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rounded}) FROM (\n{text}\n) AS result"


def inc_beta_sql(a: str, b: str, x: str, terms: int = 20000) -> str:
    """SQL of the regularised incomplete beta function as a power series, for checking tail probabilities."""
    def series(a: str, b: str, x: str) -> str:
        front = (f"exp(({a}) * ln({x}) + ({b}) * ln(1 - ({x})) + lgamma(({a}) + ({b})) - lgamma({a}) - lgamma({b}))"
                 f" / ({a})")
        term = (f"exp(lgamma(({a}) + ({b}) + k) - lgamma(({a}) + ({b})) - lgamma(({a}) + 1 + k) + lgamma(({a}) + 1)"
                f" + k * ln({x}))")
        return f"{front} * list_sum(list_transform(range(0, {terms}), lambda k: {term}))"

    return (f"CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) <= 0 THEN 0.0 WHEN ({x}) >= 1 THEN 1.0 "
            f"WHEN ({x}) <= (({a}) + 1) / (({a}) + ({b}) + 2) THEN {series(a, b, x)} "
            f"ELSE 1 - {series(b, a, f'1 - ({x})')} END")


def t_tail_sql(t: str, df: str) -> str:
    """SQL of the two-sided Student t probability."""
    return inc_beta_sql(f"({df}) / 2.0", "0.5", f"({df}) / (({df}) + ({t}) * ({t}))")


def t_width_sql(df: str) -> str:
    """SQL of the 97.5 % Student t point by its expansion around the normal point (for df of 100 or more)."""
    z = 1.959963984540054
    terms = [
        (z**3 + z, 4, 1),
        (5 * z**5 + 16 * z**3 + 3 * z, 96, 2),
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z, 384, 3),
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z, 92160, 4),
    ]
    return f"({z!r} + " + " + ".join(f"{top / below!r} / pow({df}, {p})" for top, below, p in terms) + ")"


def inference_sql(source: str, dof: str = "dof") -> str:
    """SELECT list adding statistic, p-value and limits to ``estimate`` and ``std_error`` of ``source``."""
    return (f"SELECT *, {t_tail_sql('statistic', dof)} AS p_value, "
            f"estimate - {t_width_sql(dof)} * std_error AS conf_low, "
            f"estimate + {t_width_sql(dof)} * std_error AS conf_high "
            f"FROM (SELECT *, CASE WHEN std_error > 0 THEN estimate / std_error END AS statistic FROM {source}) s")
