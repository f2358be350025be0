"""Linear models from grouped moments: many models in one pass, no design matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duowave.functions.categories import (
    GROUPS, MODERATOR_LABELS, TERM_LABELS, interaction_side, mapped_label,
    readable_term, significance_label,
)
from duowave.functions.tails import with_t_inference
from duowave.functions.text import format_interval
from duowave.operators.anova import side_by_side
from duowave.operators.ranking import order_levels
from duowave.operators.reshape import bind_results
from duowave.plans.scratch import materialize
from duowave.plans.skew import join_small

COEFFICIENT_COLUMNS = ["outcome", "predictor", "model", "term", "estimate", "std_error", "statistic", "p_value",
                       "conf_low", "conf_high", "n_obs", "dof"]


def _stacked(df: DataFrame, outcomes: Sequence[str], predictors: Sequence[str], kind: str,
             keep: Sequence[str] = ()) -> DataFrame:
    """A row per (source row, predictor, outcome) with both values known."""
    xs = F.array(*[F.struct(F.lit(p).alias("predictor"), F.col(p).cast(kind).alias("x")) for p in predictors])
    ys = F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).cast("double").alias("y")) for o in outcomes])
    return (
        df.select(*keep, ys.alias("ys"), F.explode(xs).alias("p"))
        .where("p.x is not null")
        .select(*keep, "p.predictor", "p.x", F.explode("ys").alias("o"))
        .where("o.y is not null")
        .select(*keep, "predictor", "x", "o.outcome", "o.y")
    )


def uni_lm_numeric(df: DataFrame, outcomes: Sequence[str], predictors: Sequence[str],
                   model: str = "univariate") -> DataFrame:
    """``y ~ x`` for every outcome and numeric predictor; a constant predictor has no estimate."""
    sums = _stacked(df, outcomes, predictors, "double").groupBy("outcome", "predictor").agg(
        F.regr_count("y", "x").alias("n_obs"), F.regr_sxx("y", "x").alias("sxx"),
        F.regr_sxy("y", "x").alias("sxy"), F.regr_syy("y", "x").alias("syy"),
    )
    slope = F.when(F.col("sxx") > 0, F.col("sxy") / F.nullif("sxx", F.lit(0.0)))
    rest = F.greatest(F.col("syy") - F.col("estimate") * F.col("sxy"), F.lit(0.0))
    return _coefficients(
        sums.withColumns({"estimate": slope, "dof": F.col("n_obs") - 2})
        .withColumn("std_error", F.sqrt(F.try_divide(rest, F.col("dof") * F.col("sxx"))))
        .withColumn("term", F.col("predictor")), model,
    )


def uni_lm_factor(df: DataFrame, outcomes: Sequence[str], predictors: Sequence[str],
                  model: str = "univariate", refs: Mapping[str, str] | None = None) -> DataFrame:
    """``y ~ x`` for text predictors, treatment coded against the first sorted level (or the one in ``refs``)."""
    # Written because it is read twice below; otherwise the rows would be scanned and grouped twice.
    levels = materialize(_stacked(df, outcomes, predictors, "string").groupBy("outcome", "predictor", "x").agg(
        F.count("*").alias("n"), F.avg("y").alias("m"), F.var_samp("y").alias("v")
    ), "levels")
    models = levels.withColumn("is_ref", _reference(refs)).groupBy("outcome", "predictor").agg(
        F.sum("n").alias("n_obs"), F.count("*").alias("n_levels"),
        F.sum(F.coalesce(F.col("v") * (F.col("n") - 1), F.lit(0.0))).alias("ss"),
        F.min(F.struct(~F.col("is_ref"), "x", "n", "m")).alias("ref"),
    )
    rows = join_small(levels, models, ["outcome", "predictor"], "inner").where(
        (F.col("n_levels") >= 2) & (F.col("x") != F.col("ref.x"))
    )
    mse = F.try_divide("ss", "dof")
    return _coefficients(
        rows.withColumns({"estimate": F.col("m") - F.col("ref.m"), "dof": F.col("n_obs") - F.col("n_levels")})
        .withColumn("std_error", F.sqrt(mse * (1 / F.col("n") + 1 / F.col("ref.n"))))
        .withColumn("term", F.concat("predictor", "x")), model,
    )


def _reference(refs: Mapping[str, str] | None):
    if not refs:
        return F.lit(False)
    wanted = F.create_map(*[F.lit(v) for pair in refs.items() for v in pair])
    return F.coalesce(F.col("x") == F.try_element_at(wanted, F.col("predictor")), F.lit(False))


def _coefficients(df: DataFrame, model: str) -> DataFrame:
    tested = with_t_inference(df.withColumn("std_error", F.when(F.col("dof") > 0, F.col("std_error"))))
    return tested.withColumn("model", F.lit(model)).select(*COEFFICIENT_COLUMNS)


def moderator_numeric(df: DataFrame, predictors: Sequence[str], pre: str, post: str, group: str = "group",
                      model: str = "Moderator ANCOVA") -> DataFrame:
    """Interaction of group and a numeric predictor in ``post ~ pre + group * p``.

    Within each group, pre and post are freed of the predictor by their central moments; the common
    slope on pre is then pooled over the groups.
    """
    rows = _stacked(df.where(F.col(group).isin(*GROUPS) & F.col(pre).isNotNull()), [post], predictors, "double",
                    keep=[group, pre])
    y, w, p = F.col("y"), F.col(pre).cast("double"), F.col("x")
    n = F.count("*")
    sums = rows.groupBy("outcome", "predictor", group).agg(
        n.alias("n"),
        (F.var_pop(y) * n).alias("yy"), (F.var_pop(w) * n).alias("ww"), (F.var_pop(p) * n).alias("pp"),
        (F.covar_pop(y, w) * n).alias("yw"), (F.covar_pop(y, p) * n).alias("yp"), (F.covar_pop(w, p) * n).alias("wp"),
    )

    def freed(a: str, b: str, ab: str):
        return F.col(ab) - F.try_divide(F.col(a) * F.col(b), F.col("pp"))

    parts = sums.withColumns({
        "yy_p": freed("yp", "yp", "yy"), "ww_p": freed("wp", "wp", "ww"), "yw_p": freed("yp", "wp", "yw"),
        "q": F.try_divide("wp", "pp"), "r": F.try_divide("yp", "pp"),
    })
    wide = side_by_side(parts, ["outcome", "predictor"], ["n", "yy_p", "ww_p", "yw_p", "q", "r", "pp"], group)

    def total(name: str):
        return F.col(f"{name}_c") + F.col(f"{name}_i")

    def gap(name: str):
        return F.col(f"{name}_i") - F.col(f"{name}_c")

    solved = wide.withColumns({"n_obs": total("n"), "dof": total("n") - 5, "b": F.try_divide(total("yw_p"), total("ww_p"))})
    mse = F.try_divide(F.greatest(total("yy_p") - F.col("b") * total("yw_p"), F.lit(0.0)), F.col("dof"))
    spread = (F.try_divide(F.lit(1.0), F.col("pp_c")) + F.try_divide(F.lit(1.0), F.col("pp_i"))
              + F.try_divide(gap("q") * gap("q"), total("ww_p")))
    return _coefficients(
        solved.withColumns({"estimate": gap("r") - F.col("b") * gap("q"), "std_error": F.sqrt(mse * spread)})
        .withColumn("term", F.concat(F.lit("groupIntervention:"), "predictor"))
        .where(F.col("n_obs").isNotNull()), model,
    )


def moderator_factor(df: DataFrame, predictors: Sequence[str], pre: str, post: str, group: str = "group",
                     model: str = "Moderator ANCOVA", refs: Mapping[str, str] | None = None) -> DataFrame:
    """Interactions of group and a text predictor in ``post ~ pre + group * p``, one row per non-reference level.

    A level (or reference level) that one group lacks has no estimate.
    """
    rows = _stacked(df.where(F.col(group).isin(*GROUPS) & F.col(pre).isNotNull()), [post], predictors, "string",
                    keep=[group, pre])
    y, w, n = F.col("y"), F.col(pre).cast("double"), F.count("*")
    cells = rows.groupBy("outcome", "predictor", "x", group).agg(
        n.alias("n"), F.avg(y).alias("ym"), F.avg(w).alias("wm"),
        (F.var_pop(y) * n).alias("yy"), (F.var_pop(w) * n).alias("ww"), (F.covar_pop(y, w) * n).alias("yw"),
    )
    # Written because it is read twice below.
    wide = materialize(
        side_by_side(cells, ["outcome", "predictor", "x"], ["n", "ym", "wm", "yy", "ww", "yw"], group), "cells"
    )

    def pooled(name: str):
        return F.sum(F.coalesce(f"{name}_c", F.lit(0)) + F.coalesce(f"{name}_i", F.lit(0)))

    compared = ["n_c", "n_i", "ym_c", "ym_i", "wm_c", "wm_i"]
    models = wide.withColumn("is_ref", _reference(refs)).groupBy("outcome", "predictor").agg(
        pooled("n").alias("n_obs"), F.count("n_c").alias("cells_c"), F.count("n_i").alias("cells_i"),
        pooled("yy").alias("yy"), pooled("ww").alias("ww"), pooled("yw").alias("yw"),
        F.min(F.struct(~F.col("is_ref"), "x", *compared)).alias("ref"),
    ).where("cells_c > 0 and cells_i > 0").select(
        "outcome", "predictor", "n_obs", "ref", "ww",
        (F.col("n_obs") - F.col("cells_c") - F.col("cells_i") - 1).alias("dof"),
        F.try_divide("yw", "ww").alias("b"),
        (F.col("yy") - F.coalesce(F.try_divide(F.col("yw") * F.col("yw"), F.col("ww")), F.lit(0.0))).alias("sse"),
    )
    lines = join_small(
        wide.select("outcome", "predictor", "x", *compared), models, ["outcome", "predictor"], "inner"
    ).where(F.col("x") != F.col("ref.x"))

    def double_gap(name: str):
        return F.col(f"{name}_i") - F.col(f"{name}_c") - (F.col(f"ref.{name}_i") - F.col(f"ref.{name}_c"))

    sizes = sum((1 / F.col(f"{p}n_{s}") for p in ("", "ref.") for s in "ci"), F.lit(0.0))
    spread = sizes + F.try_divide(double_gap("wm") * double_gap("wm"), F.col("ww"))
    mse = F.try_divide(F.greatest("sse", F.lit(0.0)), F.col("dof"))
    return _coefficients(
        lines.withColumns({"estimate": double_gap("ym") - F.col("b") * double_gap("wm"),
                           "std_error": F.sqrt(mse * spread)})
        .withColumn("term", F.concat(F.lit("groupIntervention:"), "predictor", "x")), model,
    )


def cross_products(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Count, means and centred cross-products of the columns per key, over complete rows.

    Output: ``n``, array ``means`` and array ``s`` holding the upper triangle row by row.
    """
    complete = df
    for c in columns:
        complete = complete.where(F.col(c).isNotNull())
    n = F.count("*")
    pairs = list(combinations_with_replacement(columns, 2))
    s = [F.covar_pop(F.col(a).cast("double"), F.col(b).cast("double")) * n for a, b in pairs]
    return complete.groupBy(*by).agg(
        n.alias("n"), F.array(*[F.avg(F.col(c).cast("double")) for c in columns]).alias("means"),
        F.array(*s).alias("s"),
    )


def symmetric(upper: Sequence[float] | np.ndarray, k: int) -> np.ndarray:
    """Square matrix from its upper triangle; leading axes are kept."""
    upper = np.asarray(upper, dtype=float)
    out = np.zeros((*upper.shape[:-1], k, k))
    i, j = np.triu_indices(k)
    out[..., i, j] = upper
    out[..., j, i] = upper
    return out


def ols_moments(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Ordinary least squares of ``y`` on numeric columns per key: all coefficients with standard errors.

    Spark reduces the rows to cross-products; each key's small system is solved inside a task.
    """
    xs = list(xs)
    k = len(xs)
    grouped = cross_products(df, [*xs, y], by)
    keys = ", ".join(f"`{name}` {kind}" for name, kind in grouped.select(*by).dtypes) if by else ""
    schema = ", ".join(filter(None, [keys, "term string, estimate double, std_error double, n_obs long, dof long"]))

    def solve(batches):
        for batch in batches:
            if not len(batch):
                continue
            # All keys of the batch as stacked matrices.
            s = symmetric(np.stack(batch["s"].to_numpy()), k + 1)
            means, n = np.stack(batch["means"].to_numpy()), batch["n"].to_numpy()
            dof = n - k - 1
            inverse = np.linalg.pinv(s[:, :k, :k], hermitian=True)
            beta = np.einsum("bij,bj->bi", inverse, s[:, :k, k])
            rest = np.maximum(s[:, k, k] - np.einsum("bi,bi->b", beta, s[:, :k, k]), 0.0)
            mse = np.where(dof > 0, rest / np.maximum(dof, 1), np.nan)
            centre = means[:, :k]
            intercept = means[:, k] - np.einsum("bi,bi->b", beta, centre)
            base = 1 / n + np.einsum("bi,bij,bj->b", centre, inverse, centre)
            spread = np.concatenate([base[:, None], np.diagonal(inverse, axis1=1, axis2=2)], axis=1)
            out = batch.loc[batch.index.repeat(k + 1), list(by)].reset_index(drop=True)
            out["term"] = np.tile(["(Intercept)", *xs], len(batch))
            out["estimate"] = np.concatenate([intercept[:, None], beta], axis=1).ravel()
            error = np.sqrt(mse[:, None] * spread).ravel()
            out["std_error"] = pd.Series(error).astype(object).where(~np.isnan(error), None)
            out["n_obs"], out["dof"] = np.repeat(n, k + 1), np.repeat(dof, k + 1)
            yield out

    return with_t_inference(grouped.mapInPandas(solve, schema))


def predictor_report(*results: DataFrame) -> DataFrame:
    """All coefficient tables as one; of moderator models only the interaction terms."""
    union = bind_results(results)
    interaction = F.col("term").rlike(r"^group.*:") | F.col("term").rlike(r":group")
    return union.where((F.col("model") != "Moderator ANCOVA") | interaction).select(*COEFFICIENT_COLUMNS)


def forest_table(report: DataFrame, labels: Mapping[str, str] = TERM_LABELS,
                 moderator_labels: Mapping[str, str] = MODERATOR_LABELS) -> DataFrame:
    """Everything a forest plot shows: label, significance, interval text, order and x-range per report."""
    by = ["outcome", "model"]
    is_moderator = F.col("model") == "Moderator ANCOVA"
    side = interaction_side(F.col("term"))
    label = F.when(
        is_moderator,
        F.concat(F.lit("Group × "), mapped_label(side, moderator_labels, F.replace(side, F.lit("_"), F.lit(" ")))),
    ).otherwise(mapped_label(F.col("term"), labels, readable_term(F.col("term"), F.col("predictor"))))
    shown = report.where(
        ~is_moderator | F.col("estimate").isNotNull() | F.col("conf_low").isNotNull() | F.col("conf_high").isNotNull()
    )
    report_rows = Window.partitionBy(*by)
    labelled = shown.withColumns({
        "label": label, "sig": significance_label("p_value"),
        "stats_label": format_interval("estimate", "conf_low", "conf_high"),
        "range_low": F.least(F.min("conf_low").over(report_rows), F.min("conf_high").over(report_rows)),
        "range_high": F.greatest(F.max("conf_low").over(report_rows), F.max("conf_high").over(report_rows)),
    })
    return order_levels(labelled, by)
