"""Queries on visits, summaries, reshaping and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from duowave.checks import rows
from duowave.checks.registry import (
    inc_beta_sql, inference_sql, query, t_tail_sql, t_width_sql,
)
from duowave.functions import categories as cat
from duowave.functions import tails, text
from duowave.operators import (
    anova, diagnostics, effects, elastic_net, imputation, joins, linear, mice, mixed_counts, ranking, reshape, response, summary,
    visits,
)
from duowave.plans.scratch import Scratch, materialize
from duowave.plans.study import Study

# The key with most distinct values first: aggregation sorts by the keys in this order.
KEYS = ["patient", "instrument"]
INSTRUMENTS = ["click", "error", "purchase", "signup", "view"]


def arms(t):
    return t["fx_patients"].select("patient_id", cat.group_label("active").alias("grp"))


def long(t):
    """First and last visits with the study arm."""
    return joins.join_group(visits.add_pre_post(t["fx_visits"], KEYS, "when_dt", "tie"), arms(t))


def pairs(t):
    """One row per patient and instrument, arm joined after the visits are reduced."""
    return joins.join_group(visits.pre_post_pairs(t["fx_visits"], KEYS, "when_dt", "tie"), arms(t))


# --- visits -----------------------------------------------------------------------------------

@query("add_pre_post", "SELECT instrument, patient, when_dt, tie, score, time FROM {long}")
def add_pre_post(t):
    return visits.add_pre_post(t["fx_visits"], KEYS, "when_dt", "tie").select(
        "instrument", "patient", "when_dt", "tie", "score", "time")


@query("visit_number", """
SELECT patient, tie, row_number() OVER (PARTITION BY patient ORDER BY authored NULLS LAST, tie) AS visit_n FROM {fx_items}""")
def visit_number(t):
    return visits.visit_number(t["fx_items"].select("patient", "authored", "tie"), ["patient"], "authored",
                               "tie").select("patient", "tie", "visit_n")


@query("when_fallback", """
SELECT patient, tie, epoch_ms(1000 * row_number() OVER (PARTITION BY patient ORDER BY tie)) AS when_dt FROM {fx_items}""")
def when_fallback(t):
    return visits.when_fallback(t["fx_items"].select("patient", "tie"), ["patient"], "tie")


@query("get_when", """
SELECT id, patient, coalesce(
  CASE id % 5 WHEN 4 THEN NULL WHEN 2 THEN strptime(raw_date, '%d.%m.%Y %H:%M') WHEN 0 THEN strptime(raw_date, '%Y-%m-%d')
    WHEN 1 THEN strptime(raw_date, '%d.%m.%Y')
    ELSE coalesce(try_strptime(raw_date, '%d/%m/%Y'), try_strptime(raw_date, '%m/%d/%Y')) END,
  CASE WHEN serial > 10000 AND serial < 80000 THEN epoch_ms(CAST((serial - 25569) * 86400000 AS BIGINT)) END) AS when_dt
FROM {fx_dates}""")
def get_when(t):
    forms = t["fx_dates"].select("id", "patient", F.col("raw_date").alias("authored"), F.col("serial").alias("date"))
    return visits.get_when(forms, "id").select("id", "patient", "when_dt")


@query("baseline_row", """
SELECT patient, instrument, when_dt, tie, score FROM (
  SELECT *, row_number() OVER (PARTITION BY patient, instrument ORDER BY when_dt NULLS LAST, tie) AS rn FROM {fx_visits})
WHERE rn = 1""")
def baseline_row(t):
    return visits.baseline_row(t["fx_visits"], KEYS, "when_dt", "tie")


@query("latest_per_cell", """
SELECT patient, grp, tie, when_dt, score FROM (
  SELECT v.*, a.grp, row_number() OVER (PARTITION BY v.patient, a.grp ORDER BY when_dt DESC, tie DESC) AS rn
  FROM {fx_visits} v LEFT JOIN {arms} a ON a.patient_id = v.patient) WHERE rn = 1""")
def latest_per_cell(t):
    dated = joins.join_group(t["fx_visits"], arms(t)).select("patient", "grp", "tie", "when_dt", "score")
    return visits.latest_per_cell(dated, ["patient", "grp"], "when_dt", "tie")


@query("cell_residual", """
SELECT instrument, patient, time, score - avg(score) OVER (PARTITION BY instrument, grp, time) AS residual
FROM {long} WHERE score IS NOT NULL AND grp IS NOT NULL""", doubles=["residual"])
def cell_residual(t):
    return diagnostics.cell_residual(long(t), ["instrument", "grp", "time"]).select(
        "instrument", "patient", "time", "residual")


# --- reshaping --------------------------------------------------------------------------------

@query("pivot_pre_post", """
SELECT instrument, patient, grp, pre AS score_pre, post AS score_post FROM {pairs}""")
def pivot_pre_post(t):
    return reshape.pivot_pre_post(long(t), [*KEYS, "grp"], prefix="score_")


@query("change_score", "SELECT instrument, patient, pre, post, change FROM {pairs}", doubles=["change"])
def change_score(t):
    return reshape.change_score(reshape.pivot_pre_post(long(t), KEYS))


@query("self_join_pre_post", """
SELECT a.patient, a.instrument, a.score AS score_pre, b.score AS score_post
FROM (SELECT * FROM {long} WHERE time = 'pre') a
LEFT JOIN (SELECT * FROM {long} WHERE time = 'post') b ON a.patient = b.patient AND a.instrument = b.instrument""")
def self_join_pre_post(t):
    return joins.self_join_pre_post(long(t), KEYS)


@query("stack_instruments", """
SELECT instrument, patient, time, score FROM {long}""")
def stack_instruments(t):
    ends = visits.add_pre_post(t["fx_visits"], KEYS, "when_dt", "tie")
    # Whatever instruments the table has.
    frames = reshape.frames_by(ends.select("instrument", "patient", "time", "score"), "instrument")
    return reshape.stack_instruments({**frames, "fatigue": None})


@query("bind_results", """
SELECT instrument, avg(pre) AS mean_pre, NULL::DOUBLE AS mean_change FROM {pairs} GROUP BY instrument
UNION ALL SELECT instrument, NULL, avg(change) FROM {pairs} GROUP BY instrument""", doubles=["mean_pre", "mean_change"])
def bind_results(t):
    wide = pairs(t)
    return reshape.bind_results([
        wide.groupBy("instrument").agg(F.avg("pre").alias("mean_pre")),
        wide.groupBy("instrument").agg(F.avg("change").alias("mean_change")),
    ])


WIDE = ", ".join(
    f"max(CASE WHEN instrument = '{i}' AND time = '{v}' THEN score END) AS {i}_{v}"
    for i in INSTRUMENTS for v in ("pre", "post"))


@query("all_scales_wide", f"SELECT patient, {WIDE} FROM {{long}} GROUP BY patient")
def all_scales_wide(t):
    return reshape.all_scales_wide(visits.add_pre_post(t["fx_visits"], KEYS, "when_dt", "tie"), "patient",
                                   {i: i for i in INSTRUMENTS})


_MERGED = "\n".join(f"FULL JOIN (SELECT * FROM w WHERE instrument = '{i}') {i} USING (patient)" for i in INSTRUMENTS[1:])


@query("full_outer_merge", f"""
, w AS (SELECT patient, instrument, grp, pre, post FROM {{pairs}})
SELECT patient, coalesce(click.grp, a.grp) AS grp, """ + ", ".join(
    f"{i}.pre AS {i}_pre, {i}.post AS {i}_post" for i in INSTRUMENTS) + f"""
FROM (SELECT * FROM w WHERE instrument = 'click') click
{_MERGED}
LEFT JOIN arms a ON a.patient_id = patient
WHERE coalesce(click.grp, a.grp) IS NOT NULL""")
def full_outer_merge(t):
    def wide(i, rows):
        return rows.select("patient", F.col("pre").alias(f"{i}_pre"), F.col("post").alias(f"{i}_post"), *(["grp"] if i == "click" else []))

    frames = reshape.frames_by(pairs(t).select("instrument", "patient", "pre", "post", "grp"), "instrument")
    return joins.full_outer_merge([wide(i, rows) for i, rows in frames.items()], "patient", arms(t), group="grp")


@query("semi_in", """
SELECT tie, patient, score FROM {fx_visits} v
WHERE EXISTS (SELECT 1 FROM {pairs} p WHERE p.patient = v.patient AND p.instrument = v.instrument AND p.change IS NOT NULL)""")
def semi_in(t):
    ids = pairs(t).where("change is not null").select(*KEYS)
    return joins.semi_in(t["fx_visits"], ids, KEYS).select("tie", "patient", "score")


@query("anti_not_in", """
SELECT tie, patient, score FROM {fx_visits} v
WHERE NOT EXISTS (SELECT 1 FROM {pairs} p WHERE p.patient = v.patient AND p.instrument = v.instrument AND p.change IS NOT NULL)""")
def anti_not_in(t):
    ids = pairs(t).where("change is not null").select(*KEYS)
    return joins.anti_not_in(t["fx_visits"], ids, KEYS).select("tie", "patient", "score")


# --- summaries --------------------------------------------------------------------------------

@query("complete_pairs", """
SELECT instrument, patient FROM {long} WHERE score IS NOT NULL GROUP BY instrument, patient HAVING count(DISTINCT time) = 2""")
def complete_pairs(t):
    return summary.complete_pairs(long(t).where("score is not null"), KEYS, distinct_times=True)


@query("contingency", """
SELECT instrument, grp, count(*) FILTER (time = 'pre') AS pre, count(*) FILTER (time = 'post') AS post,
  count(*) FILTER (time IS NULL) AS unknown_time FROM {long} GROUP BY instrument, grp""")
def contingency(t):
    return summary.contingency(long(t), row="grp")


@query("design_gate", """
SELECT *, CAST(n_control_pre + n_control_post > 0 AS BIGINT) + CAST(n_intervention_pre + n_intervention_post > 0 AS BIGINT) AS valid_groups,
  n_rows >= 3 AND least(n_control_pre, n_control_post, n_intervention_pre, n_intervention_post) > 0 AS passes
FROM (SELECT instrument, count(*) AS n_rows,
  count(*) FILTER (grp = 'Control' AND time = 'pre') AS n_control_pre,
  count(*) FILTER (grp = 'Control' AND time = 'post') AS n_control_post,
  count(*) FILTER (grp = 'Intervention' AND time = 'pre') AS n_intervention_pre,
  count(*) FILTER (grp = 'Intervention' AND time = 'post') AS n_intervention_post
FROM {long} GROUP BY instrument) c""")
def design_gate(t):
    return summary.design_gate(long(t), group="grp")


@query("mean_se", """
SELECT *, mean - se AS lower, mean + se AS upper FROM (
  SELECT instrument, grp, time, count(*) AS n, avg(score) AS mean, stddev_samp(score) / sqrt(count(*)) AS se
  FROM {long} WHERE score IS NOT NULL AND grp IS NOT NULL GROUP BY instrument, grp, time) c""",
       doubles=["mean", "se", "lower", "upper"])
def mean_se(t):
    return summary.mean_se(long(t), ["instrument", "grp", "time"])


@query("baseline_table", """
, d AS (SELECT grp, acctbal, try_cast(age_raw AS DOUBLE) AS age,
    CASE WHEN lower(trim(sex_raw)) IN ('w', 'f', 'weiblich', 'female', 'frau') THEN 'weiblich'
      WHEN lower(trim(sex_raw)) IN ('m', 'male', 'männlich', 'maennlich', 'mann') THEN 'männlich'
      WHEN lower(trim(sex_raw)) IN ('divers', 'd', 'non-binary', 'non binary', 'nb') THEN 'divers' END AS sex,
    CASE WHEN regexp_matches(lower(trim(marital_raw)), 'ledig') THEN 'Ledig'
      WHEN regexp_matches(lower(trim(marital_raw)), 'verheiratet|lebenspartnerschaft|eingetragene') THEN 'Verheiratet'
      WHEN regexp_matches(lower(trim(marital_raw)), 'geschieden') THEN 'Geschieden'
      WHEN regexp_matches(lower(trim(marital_raw)), 'verwitwet') THEN 'Verwitwet' ELSE 'Sonstiges' END AS marital
  FROM {fx_demographics}),
num AS (SELECT 'acctbal' AS variable, grp, acctbal AS x FROM d UNION ALL SELECT 'age', grp, age FROM d),
cats AS (SELECT 'sex' AS variable, grp, sex AS level FROM d UNION ALL SELECT 'marital', grp, marital FROM d),
levels AS (SELECT * FROM (VALUES ('sex', 'weiblich', 1), ('sex', 'männlich', 2), ('sex', 'divers', 3),
  ('marital', 'Ledig', 1), ('marital', 'Verheiratet', 2), ('marital', 'Geschieden', 3), ('marital', 'Verwitwet', 4),
  ('marital', 'Sonstiges', 5)) l(variable, level, level_order))
SELECT n.variable, NULL::VARCHAR AS level, 0 AS level_order, n.grp AS "group", count(x) AS n, NULL::DOUBLE AS pct,
  avg(x) AS mean, stddev_samp(x) AS sd, count(*) - count(x) AS n_missing,
  (SELECT count(o.x) FROM num o WHERE o.variable = n.variable) AS n_overall
FROM num n GROUP BY n.variable, n.grp
UNION ALL
SELECT l.variable, l.level, l.level_order, c.grp, count(*) FILTER (c.level = l.level),
  100.0 * count(*) FILTER (c.level = l.level) / count(c.level), NULL, NULL, count(*) - count(c.level),
  (SELECT count(o.level) FROM cats o WHERE o.variable = l.variable)
FROM levels l JOIN cats c ON c.variable = l.variable GROUP BY l.variable, l.level, l.level_order, c.grp""",
       doubles=["pct", "mean", "sd"])
def baseline_table(t):
    people = t["fx_demographics"].select(
        "grp", "acctbal", text.to_numeric("age_raw").alias("age"), text.canon_sex("sex_raw").alias("sex"),
        text.canon_marital("marital_raw").alias("marital"))
    return summary.baseline_table(people, ["acctbal", "age"],
                                  {"sex": text.SEX_LEVELS, "marital": text.MARITAL_LEVELS}, group="grp")


@query("value_range", """
SELECT instrument, least(min(pre), min(post)) AS range_low, greatest(max(pre), max(post)) AS range_high
FROM {pairs} GROUP BY instrument""")
def value_range(t):
    return summary.value_range(pairs(t), "pre", "post", ["instrument"])


# --- sorting and top changes ------------------------------------------------------------------

@query("rank_changes", "SELECT instrument, patient, change FROM {pairs} ORDER BY abs(change) DESC NULLS LAST, patient",
       doubles=["change"])
def rank_changes(t):
    return ranking.rank_changes(pairs(t).select("instrument", "patient", "change"))


@query("top_changes_ties", """
SELECT instrument, patient, change, abs(change) AS abs_change FROM (
  SELECT *, rank() OVER (PARTITION BY instrument ORDER BY abs(round(change)) DESC) AS r
  FROM (SELECT instrument, patient, round(change) AS change FROM {pairs} WHERE change IS NOT NULL) p) q WHERE r <= 2""",
       doubles=["change", "abs_change"])
def top_changes_ties(t):
    rounded = materialize(pairs(t).select("instrument", "patient", F.round("change").alias("change")))
    return ranking.top_changes_ties(rounded, 2, ["instrument"])


@query("top_changes_n", """
SELECT instrument, patient, change FROM (
  SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY abs(change) DESC NULLS LAST, patient) AS r FROM {pairs}) q
WHERE r <= 2""", doubles=["change"])
def top_changes_n(t):
    return ranking.top_changes_n(pairs(t), 2, ["instrument"]).select("instrument", "patient", "change")


# --- ANOVA, effects, diagnostics --------------------------------------------------------------

MOMENTS = """
, known AS (SELECT instrument, patient, grp, pre, post, change, (pre + post) / 2 AS lvl FROM {pairs}
    WHERE change IS NOT NULL AND grp IS NOT NULL)"""


def anova_steps(source: str, name: str) -> str:
    """CTEs computing the three tests from ``source`` by group means and pooled variances."""
    return f"""
, {name}_m AS (SELECT instrument, grp, count(*) AS n, avg(lvl) AS m, var_samp(lvl) AS mv, avg(change) AS d, var_samp(change) AS dv
    FROM {source} GROUP BY instrument, grp),
{name}_w AS (SELECT c.instrument, c.n + i.n - 2 AS df2, i.m - c.m AS gm, i.d - c.d AS gd, (i.d + c.d) / 2 AS md,
    (coalesce(c.mv * (c.n - 1), 0) + coalesce(i.mv * (i.n - 1), 0)) / (c.n + i.n - 2) * (1.0 / c.n + 1.0 / i.n) AS hm,
    (coalesce(c.dv * (c.n - 1), 0) + coalesce(i.dv * (i.n - 1), 0)) / (c.n + i.n - 2) * (1.0 / c.n + 1.0 / i.n) AS hd
  FROM {name}_m c JOIN {name}_m i ON i.instrument = c.instrument AND i.grp = 'Intervention'
  WHERE c.grp = 'Control' AND c.n + i.n >= 3),
{name}_f AS (SELECT instrument, 'group' AS effect, gm * gm / hm AS f_value, 1::BIGINT AS df1, df2 FROM {name}_w
  UNION ALL SELECT instrument, 'time', md * md / (hd / 4), 1, df2 FROM {name}_w
  UNION ALL SELECT instrument, 'group:time', gd * gd / hd, 1, df2 FROM {name}_w),
{name} AS (SELECT *, f_value / (f_value + df2) AS pes,
    {inc_beta_sql('df2 / 2.0', '0.5', 'df2 / (df2 + f_value)')} AS p_value FROM {name}_f)"""


ANOVA_DOUBLES = ["f_value", "pes", "p_value"]


@query("mixed_anova", MOMENTS + anova_steps("known", "tests") + "SELECT * FROM tests", doubles=ANOVA_DOUBLES)
def mixed_anova(t):
    return anova.mixed_anova(pairs(t), group="grp")


@query("anova_without_outliers", MOMENTS + """
, trimmed AS (SELECT * EXCLUDE (r) FROM (SELECT k.*, p.r FROM known k
    JOIN (SELECT instrument, patient, row_number() OVER (PARTITION BY instrument ORDER BY abs(change) DESC, patient) AS r
          FROM pairs WHERE change IS NOT NULL) p USING (instrument, patient)) WHERE r > 2)""" + anova_steps("known", "a") + anova_steps("trimmed", "b") + """
SELECT instrument, 'with outliers' AS model, f_value, df1, df2, p_value AS p_value_group_time, pes AS eta_sq_partial
FROM a WHERE effect = 'group:time'
UNION ALL SELECT instrument, 'without outliers', f_value, df1, df2, p_value, pes FROM b WHERE effect = 'group:time'""",
       doubles=["f_value", "p_value_group_time", "eta_sq_partial"])
def anova_without_outliers(t):
    return anova.anova_without_outliers(pairs(t), group="grp")


@query("residual_diagnostics", """
, r AS (SELECT instrument, score - avg(score) OVER (PARTITION BY instrument, grp, time) AS e
  FROM {long} WHERE score IS NOT NULL AND grp IS NOT NULL),
s AS (SELECT instrument, count(*) AS n, sum(e * e) / count(*) AS m2, sum(e * e * e) / count(*) AS m3,
    sum(e * e * e * e) / count(*) AS m4 FROM r GROUP BY instrument),
j AS (SELECT instrument, n, m3 / pow(m2, 1.5) AS sk, m4 / (m2 * m2) - 3 AS ku FROM s)
SELECT j.instrument, o.n_obs, n AS n_resid, sk AS skewness, ku AS excess_kurtosis,
  n / 6.0 * (sk * sk + ku * ku / 4) AS jb, exp(-(n / 6.0 * (sk * sk + ku * ku / 4)) / 2) AS p_value
FROM j JOIN (SELECT instrument, count(*) AS n_obs FROM {long} GROUP BY instrument) o USING (instrument)""",
       doubles=["skewness", "excess_kurtosis", "jb", "p_value"])
def residual_diagnostics(t):
    return diagnostics.residual_diagnostics(long(t), cell=["grp", "time"])


# A rational approximation of the normal quantile to nine digits (Acklam), by falling powers.
QUANTILE_MIDDLE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01,
                    2.506628277459239e00),
                   (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
QUANTILE_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00,
                  2.938163982698783e00),
                 (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))


def horner_sql(x, falling):
    out = repr(falling[0])
    for c in falling[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def quantile_sql(p):
    """SQL of the normal quantile."""
    q, tail = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - ({p}))))"
    middle = f"{q} * {horner_sql(f'({q} * {q})', QUANTILE_MIDDLE[0])} / {horner_sql(f'({q} * {q})', QUANTILE_MIDDLE[1])}"
    outer = f"-sign({q}) * {horner_sql(tail, QUANTILE_TAIL[0])} / {horner_sql(tail, QUANTILE_TAIL[1])}"
    return f"CASE WHEN abs({q}) <= 0.47575 THEN {middle} ELSE {outer} END"


def rising_sql(x, coefficients):
    return horner_sql(x, tuple(reversed(coefficients)))


# Every weight and value in place; for more than 11 residuals an instrument, as all have.
@query("shapiro_wilk", f"""
, r AS (SELECT instrument, score - avg(score) OVER (PARTITION BY instrument, grp, time) AS e
  FROM {{long}} WHERE score IS NOT NULL AND grp IS NOT NULL),
o AS (SELECT instrument, e, row_number() OVER (PARTITION BY instrument ORDER BY e) AS i, count(*) OVER (PARTITION BY instrument) AS n FROM r),
m AS (SELECT *, {quantile_sql('((i - 0.375) / (n + 0.25))')} AS m FROM o),
q AS (SELECT *, sum(m * m) OVER (PARTITION BY instrument) AS mm, max(m) OVER (PARTITION BY instrument) AS m1,
    max(CASE WHEN i < n THEN m END) OVER (PARTITION BY instrument) AS m2 FROM m),
w AS (SELECT *, {rising_sql('(1 / sqrt(n))', diagnostics.LARGEST)} + m1 / sqrt(mm) AS a1,
    {rising_sql('(1 / sqrt(n))', diagnostics.SECOND)} + m2 / sqrt(mm) AS a2 FROM q),
a AS (SELECT instrument, n, e, CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN i = n - 1 THEN a2 WHEN i = 2 THEN -a2
    ELSE m * sqrt((1 - 2 * a1 * a1 - 2 * a2 * a2) / (mm - 2 * m1 * m1 - 2 * m2 * m2)) END AS a FROM w),
s AS (SELECT instrument, count(*) AS n, pow(corr(a, e), 2) AS w FROM a GROUP BY instrument),
z AS (SELECT *, (ln(1 - w) - {rising_sql('ln(n)', diagnostics.MANY_MEAN)}) / exp({rising_sql('ln(n)', diagnostics.MANY_SPREAD)}) AS z FROM s)
SELECT z.instrument, n_obs, n AS n_resid, w, CASE WHEN z > 6 THEN 0.0 WHEN z < -6 THEN 1.0 ELSE 0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(
    list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(abs(z)) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))) * sign(z) END AS p_value
FROM z JOIN (SELECT instrument, count(*) AS n_obs FROM {{long}} GROUP BY instrument) c USING (instrument)""", doubles=["w", "p_value"])
def shapiro_wilk(t):
    return diagnostics.shapiro_wilk(long(t), cell=["grp", "time"])


def counts(t):
    """Visits with whole scores."""
    return long(t).withColumn("score", F.floor("score"))


# The integral over the intercept by a fine grid, digamma differences as sums.
NB_THETA, NB_SIGMA = 2.0, 0.5


@query("nb_log_likelihood", f"""
, v AS (SELECT instrument, patient, CAST(grp = 'Intervention' AS INT) AS g, CAST(time = 'post' AS INT) AS t, floor(score) AS y
  FROM {{long}} WHERE grp IS NOT NULL AND score IS NOT NULL),
c AS (SELECT instrument, g, t, ln((sum(y) + 0.5) / count(*)) AS eta FROM v GROUP BY instrument, g, t),
n AS (SELECT v.*, eta, {NB_SIGMA} * z / 20.0 AS b, exp(eta + {NB_SIGMA} * z / 20.0) AS mu
  FROM v JOIN c USING (instrument, g, t), range(-160, 161) nodes(z)),
d AS (SELECT instrument, patient, b, sum(lgamma(y + {NB_THETA}) - lgamma({NB_THETA}) - lgamma(y + 1) - {NB_THETA} * ln(1 + mu / {NB_THETA})
      + y * (ln(mu) - ln({NB_THETA} + mu))) - b * b / (2 * {NB_SIGMA} * {NB_SIGMA}) - ln({NB_SIGMA}) - 0.5 * ln(2 * pi()) AS f,
    sum({NB_THETA} * (y - mu) / ({NB_THETA} + mu)) AS d0, sum(g * {NB_THETA} * (y - mu) / ({NB_THETA} + mu)) AS d1,
    sum(t * {NB_THETA} * (y - mu) / ({NB_THETA} + mu)) AS d2, sum(g * t * {NB_THETA} * (y - mu) / ({NB_THETA} + mu)) AS d3,
    sum({NB_THETA} * (coalesce(list_sum(list_transform(range(0, CAST(y AS BIGINT)), lambda j: 1 / ({NB_THETA} + j))), 0.0)
      - ln(1 + mu / {NB_THETA}) + (mu - y) / ({NB_THETA} + mu))) AS d4,
    b * b / ({NB_SIGMA} * {NB_SIGMA}) - 1 AS d5
  FROM n GROUP BY instrument, patient, b),
p AS (SELECT instrument, patient, max(f) AS top FROM d GROUP BY instrument, patient),
e AS (SELECT instrument, patient, any_value(top) + ln(sum(exp(f - top)) * {NB_SIGMA} / 20.0) AS l, {", ".join(
    f"sum(exp(f - top) * d{k}) / sum(exp(f - top)) AS e{k}" for k in range(6))}
  FROM d JOIN p USING (instrument, patient) GROUP BY instrument, patient)
SELECT instrument, sum(l) AS log_lik, sum(e0) AS d_intercept, sum(e1) AS d_group, sum(e2) AS d_time, sum(e3) AS d_interaction,
  sum(e4) AS d_log_theta, sum(e5) AS d_log_sigma FROM e GROUP BY instrument""",
       doubles=["log_lik", "d_intercept", "d_group", "d_time", "d_interaction", "d_log_theta", "d_log_sigma"], digits=4)
def nb_log_likelihood(t):
    return mixed_counts.nb_log_likelihood(counts(t), NB_THETA, NB_SIGMA, group="grp")


NB_X = ["1", "g", "t", "g * t"]
NB_STEPS = 45


def nb_newton_sql():
    """Recursive table of Newton steps: six parameters, log-likelihood and inverse information, from derivatives on the grid.

    The six equations, with an identity matrix beside them, are eliminated one after another in nested selects.
    """
    one = {k: f"th * (y - mu) / (th + mu) * {x}" for k, x in enumerate(NB_X)}
    one[4] = """th * (coalesce(list_sum(list_transform(range(0, CAST(y AS BIGINT)), lambda j: 1 / (th + j))), 0.0)
      - ln(1 + mu / th) + (mu - y) / (th + mu))"""
    bend = "-(y + th) * th * mu / ((th + mu) * (th + mu))"
    two = {(i, j): f"{bend} * {NB_X[i]} * {NB_X[j]}" for i in range(4) for j in range(i, 4)}
    two |= {(i, 4): f"th * (y - mu) * mu / ((th + mu) * (th + mu)) * {NB_X[i]}" for i in range(4)}
    two[4, 4] = """th * th * (-coalesce(list_sum(list_transform(range(0, CAST(y AS BIGINT)), lambda j: 1 / ((th + j) * (th + j)))), 0.0)
      + mu / (th * (th + mu)) - (mu - y) / ((th + mu) * (th + mu))) + """ + one[4]
    pairs = [(i, j) for i in range(6) for j in range(i, 6)]
    prior = {(5, 5): "-2 * b * b / (sg * sg)"}
    visits = ", ".join([f"sum({v}) AS d{k}" for k, v in one.items()] + [f"sum({v}) AS h{i}{j}" for (i, j), v in two.items()])
    mean = "sum(w * ({0})) / sum(w)"
    people = ", ".join([f"{mean.format(f'd{k}')} AS e{k}" for k in range(6)] + [
        mean.format(f"{f'h{i}{j}' if (i, j) in two else prior.get((i, j), '0.0')} + d{i} * d{j}")
        + f" - {mean.format(f'd{i}')} * {mean.format(f'd{j}')} AS c{i}{j}" for i, j in pairs])
    held = "CASE WHEN p[6] <= -8 THEN 1e12 ELSE 0.0 END"
    rows = ", ".join("[" + ", ".join([f"-sum(c{min(i, j)}{max(i, j)})" + (f" + {held}" if i == j == 5 else "") for j in range(6)] + [f"sum(e{i})"]
                                     + ["1.0" if i == j else "0.0" for j in range(6)]) + "]" for i in range(6))
    solved = f"SELECT instrument, step, p, sum(l) AS ll, [{rows}] AS m FROM people GROUP BY instrument, step, p"
    for k in range(1, 7):
        solved = f"""SELECT instrument, step, p, ll, list_transform(m, lambda r, i: CASE WHEN i = {k} THEN q
          ELSE list_transform(r, lambda v, j: v - r[{k}] * q[j]) END) AS m
        FROM (SELECT *, list_transform(m[{k}], lambda v: v / m[{k}][{k}]) AS q FROM ({solved}))"""
    return f"""
nb AS (
  SELECT instrument, 0 AS step, CAST([c0, i0 - c0, c1 - c0, i1 - i0 - c1 + c0, ln({NB_THETA}), ln({NB_SIGMA})] AS DOUBLE[]) AS p,
    CAST(NULL AS DOUBLE) AS ll, CAST(NULL AS DOUBLE[]) AS v
  FROM (SELECT instrument, max(CASE WHEN g = 0 AND t = 0 THEN eta END) AS c0, max(CASE WHEN g = 1 AND t = 0 THEN eta END) AS i0,
      max(CASE WHEN g = 0 AND t = 1 THEN eta END) AS c1, max(CASE WHEN g = 1 AND t = 1 THEN eta END) AS i1 FROM c GROUP BY instrument)
  UNION ALL
  SELECT instrument, step + 1, list_transform(p, lambda x, i: greatest(x + m[i][7] * least(1.0, 1.0 / list_max(list_transform(m, lambda r: abs(r[7])))),
      CASE WHEN i > 4 THEN -8.0 ELSE -1e9 END)), ll, list_transform(range(1, 5), lambda i: m[i][7 + i])
  FROM (WITH nodes AS (
      SELECT nb.instrument, step, p, patient, g, t, y, z, exp(p[5]) AS th, exp(p[6]) AS sg, exp(p[6]) * z / 20.0 AS b,
        exp(p[1] + p[2] * g + p[3] * t + p[4] * g * t + exp(p[6]) * z / 20.0) AS mu
      FROM nb JOIN v USING (instrument), range(-160, 161) grid(z) WHERE step < {NB_STEPS}),
    visits AS (SELECT instrument, step, p, patient, z, b, sg, sum(lgamma(y + th) - lgamma(th) - lgamma(y + 1) - th * ln(1 + mu / th)
        + y * (ln(mu) - ln(th + mu))) - b * b / (2 * sg * sg) - ln(sg) - 0.5 * ln(2 * pi()) AS f, {visits}, b * b / (sg * sg) - 1 AS d5
      FROM nodes GROUP BY instrument, step, p, patient, z, b, sg),
    weighed AS (SELECT *, max(f) OVER (PARTITION BY instrument, patient) AS top, exp(f - max(f) OVER (PARTITION BY instrument, patient)) AS w FROM visits),
    people AS (SELECT instrument, step, p, patient, any_value(top) + ln(sum(w) * any_value(sg) / 20.0) AS l, {people}
      FROM weighed GROUP BY instrument, step, p, patient)
    {solved}))"""


@query("nb_mixed_model", f"""
, v AS (SELECT instrument, patient, CAST(grp = 'Intervention' AS INT) AS g, CAST(time = 'post' AS INT) AS t, floor(score) AS y
  FROM {{long}} WHERE grp IS NOT NULL AND score IS NOT NULL),
c AS (SELECT instrument, g, t, ln((sum(y) + 0.5) / count(*)) AS eta FROM v GROUP BY instrument, g, t),{nb_newton_sql()},
fit AS (SELECT nb.instrument, p, ll, v, n_obs, n_patients FROM nb JOIN (
  SELECT instrument, count(*) AS n_obs, count(DISTINCT patient) AS n_patients FROM v GROUP BY instrument) USING (instrument) WHERE step = {NB_STEPS}),
terms AS (SELECT *, p[i] AS estimate, sqrt(v[i]) AS std_error, p[i] / sqrt(v[i]) AS statistic FROM fit, range(1, 5) places(i))
SELECT instrument, {[*mixed_counts.TERMS]!r}[i] AS term, estimate, std_error, statistic, CASE WHEN abs(statistic) > 6 THEN 0.0 ELSE
    1 - 2 * exp(-statistic * statistic / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k:
      exp((2 * k + 1) * ln(abs(statistic)) + k * ln(2) + lgamma(k + 1) - lgamma(2 * k + 2)))) END AS p_value,
  exp(p[5]) AS theta, CASE WHEN p[6] > -8 THEN exp(p[6]) ELSE 0.0 END AS sigma, ll AS log_lik, n_obs, n_patients, 'fitted' AS status FROM terms""",
       doubles=["estimate", "std_error", "statistic", "p_value", "theta", "sigma", "log_lik"], digits=4)
def nb_mixed_model(t):
    return mixed_counts.nb_mixed_model(counts(t), group="grp")


@query("regression_impute", """
SELECT v.tie, v.score, a.grp, coalesce(v.score, CASE WHEN a.grp IS NOT NULL THEN
  avg(v.score) OVER (PARTITION BY v.instrument, a.grp) END) AS score_imp
FROM {fx_visits} v LEFT JOIN {arms} a ON a.patient_id = v.patient""", doubles=["score_imp"])
def regression_impute(t):
    scores = joins.join_group(t["fx_visits"], arms(t))
    return imputation.regression_impute(scores, "score", "grp", ["instrument"], "score_imp").select(
        "tie", "score", "grp", "score_imp")


DZ = """
, stats AS (SELECT instrument, grp, count(change) AS n, avg(change) AS m, stddev_samp(change) AS s, var_samp(change) AS v
    FROM {pairs} WHERE grp IS NOT NULL GROUP BY instrument, grp),
dz AS (SELECT instrument, grp, n, m / s AS dz, sqrt(1.0 / n + pow(m / s, 2) / (2 * (n - 1))) AS se FROM stats WHERE n >= 2 AND s > 0),
g0 AS (SELECT c.instrument, i.n AS n_i, c.n AS n_c, (i.m - c.m) / sqrt(((i.n - 1) * i.v + (c.n - 1) * c.v) / (i.n + c.n - 2))
    * (1 - 3.0 / (4 * (i.n + c.n) - 9)) AS g
  FROM stats c JOIN stats i ON i.instrument = c.instrument AND i.grp = 'Intervention' WHERE c.grp = 'Control'),
g1 AS (SELECT *, sqrt((n_i + n_c) / (n_i * n_c)::DOUBLE + g * g / (2 * (n_i + n_c - 2))) AS se FROM g0)
"""


@query("effect_dz", DZ + "SELECT *, dz - 1.96 * se AS ci_low, dz + 1.96 * se AS ci_high FROM dz",
       doubles=["dz", "se", "ci_low", "ci_high"])
def effect_dz(t):
    return effects.effect_dz(pairs(t), group="grp")


@query("effect_hedges_g", DZ + "SELECT *, g - 1.96 * se AS ci_low, g + 1.96 * se AS ci_high FROM g1",
       doubles=["g", "se", "ci_low", "ci_high"])
def effect_hedges_g(t):
    return effects.effect_hedges_g(pairs(t), group="grp")


@query("effect_table", DZ + """
SELECT instrument, concat('dz (within) ', grp) AS metric, dz AS effect, dz - 1.96 * se AS ci_low, dz + 1.96 * se AS ci_high,
  CAST(n AS VARCHAR) AS n FROM dz
UNION ALL SELECT instrument, 'g (between Δ)', g, g - 1.96 * se, g + 1.96 * se, concat('I=', n_i, ', C=', n_c) FROM g1""",
       doubles=["effect", "ci_low", "ci_high"], digits=3)
def effect_table(t):
    return effects.effect_table(pairs(t), group="grp")


# --- linear models ----------------------------------------------------------------------------

COEFS = ["estimate", "std_error", "statistic", "p_value", "conf_low", "conf_high"]
COEF_ORDER = ("outcome, predictor, model, term, estimate, std_error, statistic, p_value, conf_low, conf_high, "
              "n_obs, dof")

NUMERIC_ROWS = "\nUNION ALL ".join(
    f"SELECT '{y}' AS outcome, '{x}' AS predictor, {ys} AS y, {x} AS x FROM {{fx_baseline}}"
    for y, ys in (("score_pre", "score_pre"), ("delta", "score_post - score_pre")) for x in ("acctbal", "n_orders"))

UNI_NUMERIC = f"""
, nrows AS ({NUMERIC_ROWS}),
nm AS (SELECT outcome, predictor, count(*) AS n_obs, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy
  FROM nrows WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY outcome, predictor),
nfit AS (SELECT outcome, predictor, 'univariate' AS model, predictor AS term, sxy / sxx AS estimate,
    sqrt((syy - sxy * sxy / sxx) / (n_obs - 2) / sxx) AS std_error, n_obs, n_obs - 2 AS dof FROM nm),
uni_numeric AS ({inference_sql('nfit')})
"""

FACTOR_ROWS = "\nUNION ALL ".join(
    f"SELECT '{y}' AS outcome, '{x}' AS predictor, {ys} AS y, {x} AS x FROM {{fx_baseline}}"
    for y, ys in (("score_pre", "score_pre"), ("delta", "score_post - score_pre")) for x in ("segment", "region"))

UNI_FACTOR = f"""
, frows AS ({FACTOR_ROWS}),
flev AS (SELECT outcome, predictor, x, count(*) AS n, avg(y) AS m, coalesce(var_samp(y) * (count(*) - 1), 0) AS ss
  FROM frows WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY outcome, predictor, x),
fmod AS (SELECT outcome, predictor, sum(n)::BIGINT AS n_obs, count(*) AS nl, sum(ss) AS ss, min(x) AS ref FROM flev GROUP BY outcome, predictor),
ffit AS (SELECT l.outcome, l.predictor, 'univariate' AS model, concat(l.predictor, l.x) AS term, l.m - r.m AS estimate,
    sqrt(k.ss / (k.n_obs - k.nl) * (1.0 / l.n + 1.0 / r.n)) AS std_error, k.n_obs, k.n_obs - k.nl AS dof
  FROM flev l JOIN fmod k ON k.outcome = l.outcome AND k.predictor = l.predictor
  JOIN flev r ON r.outcome = k.outcome AND r.predictor = k.predictor AND r.x = k.ref WHERE l.x <> k.ref),
uni_factor AS ({inference_sql('ffit')})
"""


def outcomes(t):
    return t["fx_baseline"].withColumn("delta", F.col("score_post") - F.col("score_pre"))


@query("uni_lm_numeric", UNI_NUMERIC + f"SELECT {COEF_ORDER} FROM uni_numeric", doubles=COEFS)
def uni_lm_numeric(t):
    return linear.uni_lm_numeric(outcomes(t), ["score_pre", "delta"], ["acctbal", "n_orders"])


@query("uni_lm_factor", UNI_FACTOR + f"SELECT {COEF_ORDER} FROM uni_factor", doubles=COEFS)
def uni_lm_factor(t):
    return linear.uni_lm_factor(outcomes(t), ["score_pre", "delta"], ["segment", "region"])


MOD_NUMERIC = """
, mrows AS (SELECT 'acctbal' AS predictor, grp, score_post AS y, score_pre AS w, acctbal AS p FROM {fx_baseline}
    UNION ALL SELECT 'n_orders', grp, score_post, score_pre, n_orders FROM {fx_baseline}),
mg AS (SELECT predictor, grp, count(*) AS n, regr_sxx(y, p) AS spp, regr_sxy(y, p) AS syp, regr_sxy(w, p) AS swp,
    regr_sxx(p, w) AS sww, regr_sxy(y, w) AS syw, regr_syy(y, w) AS syy
  FROM mrows WHERE y IS NOT NULL AND w IS NOT NULL AND p IS NOT NULL GROUP BY predictor, grp),
mt AS (SELECT predictor, sum(n)::BIGINT AS n, sum(sww - swp * swp / spp) AS a, sum(syw - syp * swp / spp) AS b,
    sum(syy - syp * syp / spp) AS c, sum(1 / spp) AS ip FROM mg GROUP BY predictor),
mfit AS (SELECT 'score_post' AS outcome, t.predictor, 'Moderator ANCOVA' AS model, concat('groupIntervention:', t.predictor) AS term,
    (i.syp - t.b / t.a * i.swp) / i.spp - (c.syp - t.b / t.a * c.swp) / c.spp AS estimate,
    sqrt((t.c - t.b * t.b / t.a) / (t.n - 5) * (t.ip + pow(i.swp / i.spp - c.swp / c.spp, 2) / t.a)) AS std_error,
    t.n AS n_obs, t.n - 5 AS dof
  FROM mt t JOIN mg c ON c.predictor = t.predictor AND c.grp = 'Control' JOIN mg i ON i.predictor = t.predictor AND i.grp = 'Intervention'),
mod_numeric AS (""" + inference_sql("mfit") + """)
"""

MOD_FACTOR = """
, xrows AS (SELECT 'segment' AS predictor, grp, score_post AS y, score_pre AS w, segment AS x FROM {fx_baseline}
    UNION ALL SELECT 'region', grp, score_post, score_pre, region FROM {fx_baseline}),
xc AS (SELECT predictor, x, grp, count(*) AS n, avg(y) AS ym, avg(w) AS wm, regr_sxx(y, w) AS ww, regr_sxy(y, w) AS yw,
    regr_syy(y, w) AS yy FROM xrows WHERE y IS NOT NULL AND w IS NOT NULL AND x IS NOT NULL GROUP BY predictor, x, grp),
xt AS (SELECT predictor, sum(n)::BIGINT AS n, count(*) AS cells, sum(ww) AS ww, sum(yw) / sum(ww) AS b,
    sum(yy) - sum(yw) * sum(yw) / sum(ww) AS sse, min(x) AS ref FROM xc GROUP BY predictor),
xl AS (SELECT c.predictor, c.x, i.ym - c.ym AS dy, i.wm - c.wm AS dw, 1.0 / i.n + 1.0 / c.n AS inv
  FROM xc c JOIN xc i ON i.predictor = c.predictor AND i.x = c.x AND i.grp = 'Intervention' WHERE c.grp = 'Control'),
xfit AS (SELECT 'score_post' AS outcome, l.predictor, 'Moderator ANCOVA' AS model, concat('groupIntervention:', l.predictor, l.x) AS term,
    (l.dy - r.dy) - t.b * (l.dw - r.dw) AS estimate,
    sqrt(t.sse / (t.n - t.cells - 1) * (l.inv + r.inv + pow(l.dw - r.dw, 2) / t.ww)) AS std_error, t.n AS n_obs, t.n - t.cells - 1 AS dof
  FROM xl l JOIN xt t ON t.predictor = l.predictor JOIN xl r ON r.predictor = t.predictor AND r.x = t.ref WHERE l.x <> t.ref),
mod_factor AS (""" + inference_sql("xfit") + """)
"""


@query("moderator_numeric", MOD_NUMERIC + f"SELECT {COEF_ORDER} FROM mod_numeric", doubles=COEFS)
def moderator_numeric(t):
    return linear.moderator_numeric(t["fx_baseline"], ["acctbal", "n_orders"], "score_pre", "score_post", "grp")


@query("moderator_factor", MOD_FACTOR + f"SELECT {COEF_ORDER} FROM mod_factor", doubles=COEFS)
def moderator_factor(t):
    return linear.moderator_factor(t["fx_baseline"], ["segment", "region"], "score_pre", "score_post", "grp")


@query("ols_moments", """
, d AS (SELECT grp, score_post AS y, score_pre AS a, n_orders AS b FROM {fx_baseline}
    WHERE score_post IS NOT NULL AND score_pre IS NOT NULL AND n_orders IS NOT NULL),
m AS (SELECT grp, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_samp(a) * (count(*) - 1) AS saa,
    var_samp(b) * (count(*) - 1) AS sbb, covar_samp(a, b) * (count(*) - 1) AS sab, covar_samp(a, y) * (count(*) - 1) AS say,
    covar_samp(b, y) * (count(*) - 1) AS sby, var_samp(y) * (count(*) - 1) AS syy FROM d GROUP BY grp),
s AS (SELECT *, saa * sbb - sab * sab AS det FROM m),
c AS (SELECT *, (sbb * say - sab * sby) / det AS ba, (saa * sby - sab * say) / det AS bb FROM s),
e AS (SELECT *, (syy - ba * say - bb * sby) / (n - 3) AS mse FROM c),
fit AS (SELECT grp, '(Intercept)' AS term, my - ba * ma - bb * mb AS estimate,
    sqrt(mse * (1.0 / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det)) AS std_error, n AS n_obs, n - 3 AS dof FROM e
  UNION ALL SELECT grp, 'score_pre', ba, sqrt(mse * sbb / det), n, n - 3 FROM e
  UNION ALL SELECT grp, 'n_orders', bb, sqrt(mse * saa / det), n, n - 3 FROM e)
""" + inference_sql("fit"), doubles=COEFS)
def ols_moments(t):
    return linear.ols_moments(t["fx_baseline"], "score_post", ["score_pre", "n_orders"], ["grp"])


def reports(t):
    base = materialize(outcomes(t), "baseline")
    return linear.predictor_report(
        linear.uni_lm_numeric(base, ["score_pre", "delta"], ["acctbal", "n_orders"]),
        linear.uni_lm_factor(base, ["score_pre", "delta"], ["segment", "region"]),
        linear.moderator_numeric(base, ["acctbal", "n_orders"], "score_pre", "score_post", "grp"),
        linear.moderator_factor(base, ["segment", "region"], "score_pre", "score_post", "grp"))


REPORT = UNI_NUMERIC + UNI_FACTOR + MOD_NUMERIC + MOD_FACTOR + f"""
, report AS (SELECT {COEF_ORDER} FROM uni_numeric UNION ALL SELECT {COEF_ORDER} FROM uni_factor
  UNION ALL SELECT {COEF_ORDER} FROM mod_numeric UNION ALL SELECT {COEF_ORDER} FROM mod_factor)
"""


@query("predictor_report", REPORT + "SELECT * FROM report", doubles=COEFS)
def predictor_report(t):
    return reports(t)


SHOWN = """
SELECT outcome, model, predictor, term, estimate, conf_low, conf_high,
  CASE WHEN model = 'univariate' AND term = predictor THEN replace(predictor, '_', ' ')
    WHEN model = 'univariate' THEN replace(concat(predictor, ': ', substr(term, length(predictor) + 1)), '_', ' ')
    ELSE concat('Group × ', replace(replace(term, 'groupIntervention:', ''), '_', ' ')) END AS label,
  CASE WHEN p_value < 0.01 THEN 'p < .01' WHEN p_value < 0.05 THEN 'p < .05' ELSE 'n.s.' END AS sig,
  printf('%.2f [%.2f, %.2f]', estimate, conf_low, conf_high) AS stats_label,
  row_number() OVER (PARTITION BY outcome, model ORDER BY estimate, term) AS label_order,
  min(conf_low) OVER (PARTITION BY outcome, model) AS range_low, max(conf_high) OVER (PARTITION BY outcome, model) AS range_high
FROM report"""


@query("forest_table", REPORT + SHOWN, doubles=["estimate", "conf_low", "conf_high", "range_low", "range_high"])
def forest_table(t):
    return linear.forest_table(reports(t)).select(
        "outcome", "model", "predictor", "term", "estimate", "conf_low", "conf_high", "label", "sig", "stats_label",
        F.col("label_order").cast("long").alias("label_order"), "range_low", "range_high")


@query("order_levels", UNI_FACTOR + """
SELECT outcome, model, term, row_number() OVER (PARTITION BY outcome, model ORDER BY estimate, term) AS label_order
FROM uni_factor""")
def order_levels(t):
    return ranking.order_levels(uni_lm_factor(t), ["outcome", "model"]).select(
        "outcome", "model", "term", F.col("label_order").cast("long").alias("label_order"))


# --- response ---------------------------------------------------------------------------------

# Direction of improvement and threshold per instrument; None is half the baseline deviation.
RULES = {"click": ("lower", None), "error": ("lower", 5), "purchase": ("higher", 10), "signup": ("higher", None),
         "view": ("lower", 10)}
RESPONSE = """
, mcid AS (SELECT instrument, CASE WHEN instrument IN ('click', 'error', 'view') THEN 'lower' ELSE 'higher' END AS direction,
    CASE instrument WHEN 'error' THEN 5 WHEN 'purchase' THEN 10 WHEN 'view' THEN 10 ELSE 0.5 * stddev_samp(pre) END AS mcid
  FROM {pairs} GROUP BY instrument),
resp AS (SELECT p.*, m.mcid, CASE WHEN direction = 'lower' THEN -change ELSE change END >= mcid AS responder,
    CASE WHEN direction = 'lower' THEN -change ELSE change END <= -mcid AS worsener
  FROM pairs p JOIN mcid m USING (instrument)),
cells AS (SELECT instrument, nullif(count(*) FILTER (responder AND grp = 'Intervention'), 0)::DOUBLE AS a,
    nullif(count(*) FILTER (NOT responder AND grp = 'Intervention'), 0)::DOUBLE AS b,
    nullif(count(*) FILTER (responder AND grp = 'Control'), 0)::DOUBLE AS c,
    nullif(count(*) FILTER (NOT responder AND grp = 'Control'), 0)::DOUBLE AS d FROM resp GROUP BY instrument),
logit AS (SELECT instrument, '(Intercept)' AS term, ln(c / d) AS estimate, sqrt(1 / c + 1 / d) AS std_error FROM cells
  UNION ALL SELECT instrument, 'groupIntervention', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM cells),
tested AS (SELECT *, estimate / std_error AS statistic FROM logit)
"""
# Two-sided normal probability by the Maclaurin series of the error function.
Z_TAIL = ("1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k: pow(-1, k) * exp((2 * k + 1) * "
          "ln(greatest(abs(statistic), 1e-300) / sqrt(2)) - lgamma(k + 1)) / (2 * k + 1)))")


def responses(t):
    both = materialize(pairs(t), "pairs")
    return response.classify_response(both, response.mcid_threshold(both, RULES))


@query("mcid_threshold", RESPONSE + "SELECT instrument, direction, mcid FROM mcid", doubles=["mcid"])
def mcid_threshold(t):
    return response.mcid_threshold(pairs(t), RULES)


@query("classify_response", RESPONSE + "SELECT instrument, patient, change, responder, worsener FROM resp",
       doubles=["change"])
def classify_response(t):
    return responses(t).select("instrument", "patient", "change", "responder", "worsener")


@query("responder_rates", RESPONSE + """
SELECT instrument, grp, count(*) AS n, count(responder) AS n_valid, count(*) FILTER (responder) AS responders,
  count(*) FILTER (worsener) AS worseners, count(*) FILTER (responder) / count(*)::DOUBLE AS resp_rate
FROM resp GROUP BY instrument, grp""", doubles=["resp_rate"])
def responder_rates(t):
    return response.responder_rates(responses(t), ["instrument", "grp"])


@query("logit_or", RESPONSE + f"SELECT instrument, term, estimate, std_error, statistic, {Z_TAIL} AS p_value FROM tested",
       doubles=["estimate", "std_error", "statistic", "p_value"])
def logit_or(t):
    return response.logit_or(responses(t), group="grp")


@query("odds_ratio_table", RESPONSE + f"""
SELECT instrument, exp(estimate) AS odds_ratio, exp(estimate - 1.96 * std_error) AS ci_low,
  exp(estimate + 1.96 * std_error) AS ci_high, {Z_TAIL} AS p_value FROM tested WHERE term = 'groupIntervention'""",
       doubles=["odds_ratio", "ci_low", "ci_high", "p_value"])
def odds_ratio_table(t):
    return response.odds_ratio_table(response.logit_or(responses(t), group="grp"))


# --- multiple imputation ----------------------------------------------------------------------

FITS = """
, mi AS (SELECT imp::INT AS imp, instrument, grp, count(*) AS n, avg(post - pre) AS m, var_samp(post - pre) AS v
  FROM {fx_imputed} GROUP BY imp, instrument, grp),
fits AS (SELECT c.imp, c.instrument, i.m - c.m AS estimate,
    ((c.n - 1) * c.v + (i.n - 1) * i.v) / (c.n + i.n - 2) * (1.0 / c.n + 1.0 / i.n) AS variance, c.n + i.n - 2 AS dof
  FROM mi c JOIN mi i ON i.imp = c.imp AND i.instrument = c.instrument AND i.grp = 'Intervention' WHERE c.grp = 'Control')
"""


@query("mi_delta_fit", FITS + "SELECT * FROM fits", doubles=["estimate", "variance"])
def mi_delta_fit(t):
    return imputation.mi_delta_fit(t["fx_imputed"], group="grp")


@query("rubin_pool", FITS + f"""
, q AS (SELECT instrument, count(*) AS m, avg(estimate) AS estimate, avg(variance) AS u, var_samp(estimate) AS b, min(dof) AS vc
  FROM fits GROUP BY instrument),
l AS (SELECT *, u + (1 + 1.0 / m) * b AS t, (1 + 1.0 / m) * b / (u + (1 + 1.0 / m) * b) AS lam FROM q),
o AS (SELECT *, (vc + 1.0) / (vc + 3) * vc * (1 - lam) AS vo, (m - 1) / (lam * lam) AS vold FROM l),
p AS (SELECT *, vold * vo / (vold + vo) AS dof, sqrt(t) AS std_error, estimate / sqrt(t) AS statistic FROM o)
SELECT instrument, 'groupIntervention' AS term, estimate, std_error, statistic, dof,
  {t_tail_sql('statistic', 'dof')} AS p_value, estimate - {t_width_sql('dof')} * std_error AS conf_low,
  estimate + {t_width_sql('dof')} * std_error AS conf_high, m FROM p""", doubles=[*COEFS, "dof"])
def rubin_pool(t):
    return imputation.rubin_pool(imputation.mi_delta_fit(t["fx_imputed"], group="grp"))


IMPUTED = ["arm", "score_pre", "score_post", "acctbal", "n_orders"]


def _numbers(t):
    return t["fx_baseline"].withColumn("arm", cat.group_dummy("grp").cast("double"))


# Per copy and variable: rows, fills, observed cells that changed and fills that were never observed.
@query("mice_pmm", """
SELECT i.imp::INT AS imp, v.variable, v.n_rows, v.n_filled, 0::BIGINT AS n_changed, 0::BIGINT AS n_unseen
FROM (SELECT unnest(range(1, 21)) AS imp) i
CROSS JOIN (
""" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*)::BIGINT AS n_rows, count(CASE WHEN {x} IS NULL THEN 1 END)::BIGINT AS n_filled FROM {{fx_baseline}}"
    for c, x in [("arm", "grp"), *[(c, c) for c in IMPUTED[1:]]]) + ") v")
def mice_pmm(t):
    # Computed once, as it is read twice per variable.
    numbers = materialize(_numbers(t).select("patient", *IMPUTED), "numbers")
    copies = materialize(mice.mice_pmm(numbers, "patient", IMPUTED), "copies")
    seen = numbers.select("patient", *[F.col(c).alias(f"o_{c}") for c in IMPUTED])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"),
                                         F.col(f"o_{c}").cast("double").alias("observed")) for c in IMPUTED]))
    rows = copies.join(seen, "patient").select("imp", cells.alias("cell")).select("imp", "cell.*")
    given = numbers.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
                                               for c in IMPUTED])).alias("g")).select("g.*").where("value IS NOT NULL").distinct()
    filled = F.col("observed").isNull()
    counts = rows.groupBy("imp", "variable").agg(
        F.count("*").alias("n_rows"), F.count_if(filled).alias("n_filled"),
        F.count_if(~filled & ~F.col("value").eqNullSafe(F.col("observed"))).alias("n_changed"))
    # Only fills are looked up among the observed values.
    unseen = rows.where(filled).join(given, ["variable", "value"], "left_anti").groupBy("imp", "variable").agg(F.count("*").alias("n_unseen"))
    return counts.join(unseen, ["imp", "variable"], "left").withColumn("n_unseen", F.coalesce("n_unseen", F.lit(0).cast("long")))


_PLACES = """
, cells AS (SELECT imp::INT AS imp, patient, CASE WHEN patient % 4 <> 0 THEN acctbal END AS value, (patient * 7919 % 13)::DOUBLE AS spot,
    (patient * 104729 % 1000003)::BIGINT AS tie, (patient * 31 % 97) / 97.0::DOUBLE AS pick, acctbal IS NOT NULL AND patient % 4 <> 0 AS is_donor
  FROM {fx_baseline} CROSS JOIN (SELECT unnest([1, 2]) AS imp) i)
"""


# One matching step: of the five donors before and after a gap, one of the five nearest by position.
@query("mice_match_step", _PLACES + """
, ordered AS (SELECT *, sum(CASE WHEN is_donor THEN 1 ELSE 0 END) OVER (PARTITION BY imp ORDER BY spot, tie ROWS UNBOUNDED PRECEDING) AS upto
  FROM cells),
donors AS (SELECT imp, spot, value, upto AS place FROM ordered WHERE is_donor),
near AS (SELECT g.imp, g.patient, g.pick, d.value,
    row_number() OVER (PARTITION BY g.imp, g.patient ORDER BY abs(d.spot - g.spot), d.place) AS nearest,
    least(5, (SELECT count(*) FROM donors c WHERE c.imp = g.imp)) AS take
  FROM ordered g JOIN donors d ON d.imp = g.imp AND d.place BETWEEN g.upto - 4 AND g.upto + 5 WHERE NOT g.is_donor)
SELECT imp, patient, value FROM near WHERE nearest = 1 + least(floor(pick * take), take - 1)
UNION ALL SELECT imp, patient, value FROM cells WHERE is_donor""")
def mice_match_step(t):
    base = t["fx_baseline"].select("patient", "acctbal", F.explode(F.array(F.lit(1), F.lit(2))).alias("imp"))
    donor = F.col("acctbal").isNotNull() & (F.col("patient") % 4 != 0)
    rows = base.select(
        "imp", "patient", F.when(donor, F.col("acctbal")).alias("value"), donor.alias("is_donor"),
        (F.col("patient") * 7919 % 13).cast("double").alias("at"), (F.col("patient") * 104729 % 1000003).cast("long").alias("tie"),
        (F.col("patient") * 31 % 97 / F.lit(97.0)).alias("pick"))
    n = base.count() // 2
    # Small buckets, so that donors beyond a bucket's border count.
    found = mice._impute_step(rows, "value", n, 2, Scratch(t.spark, "match"), 5, 100)
    return found.select("imp", "patient", "value")


@query("dist_tail", f"""
, s AS (SELECT instrument, count(change) - 1 AS dof, avg(change) / (stddev_samp(change) / sqrt(count(change))) AS t
  FROM {{pairs}} GROUP BY instrument)
SELECT instrument, dof, t, {t_tail_sql('t', 'dof')} AS p_t, {inc_beta_sql('dof / 2.0', '1.5', 'dof / (dof + 3 * t * t)')} AS p_f,
  {t_width_sql('dof')} AS t_crit FROM s""", doubles=["t", "p_t", "p_f", "t_crit"])
def dist_tail(t):
    stats = pairs(t).groupBy("instrument").agg(
        (F.count("change") - 1).alias("dof"),
        (F.avg("change") / (F.stddev_samp("change") / F.sqrt(F.count("change")))).alias("t"))
    dof = F.col("dof").cast("double")
    return stats.withColumns({
        "p_t": tails.t_two_sided("t", dof), "p_f": tails.f_upper(F.col("t") * F.col("t"), F.lit(3.0), dof),
        "t_crit": tails.t_critical(dof)})


# --- elastic net ------------------------------------------------------------------------------

NET_NUMERIC, NET_FACTORS, NET_PRE = ["acctbal", "n_orders"], ["region"], "score_pre"
NET_REGIONS = ["AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
NET_MAIN = NET_NUMERIC + [f"region{r}" for r in NET_REGIONS]
NET_TERMS = [NET_PRE, "groupIntervention", *NET_MAIN, *[f"groupIntervention:{m}" for m in NET_MAIN]]
NET_P, NET_FOLDS, NET_SHARE, NET_SWEEPS = len(NET_TERMS), 5, 0.1, 120
_main = ", ".join([*NET_NUMERIC, *[f"CAST(region = '{r}' AS DOUBLE)" for r in NET_REGIONS]])
_arm = ", ".join(f"g * {m}" for m in [*NET_NUMERIC, *[f"CAST(region = '{r}' AS DOUBLE)" for r in NET_REGIONS]])

# Coordinate descent by a recursive table over explicit rows: f is the fold left out, or -1.
NET = f"""
, b AS (SELECT patient, CAST('0x' || substr(md5(CAST(patient AS VARCHAR)), 1, 8) AS BIGINT) % {NET_FOLDS} AS fold, score_post AS y,
    CAST([score_pre, g, {_main}, {_arm}] AS DOUBLE[]) AS x
  FROM (SELECT *, CAST(grp = 'Intervention' AS INT) AS g FROM {{fx_baseline}})
  WHERE score_pre IS NOT NULL AND score_post IS NOT NULL AND acctbal IS NOT NULL AND n_orders IS NOT NULL),
tr AS (SELECT f, patient, y - avg(y) OVER (PARTITION BY f) AS y, i, x[i] AS v, avg(x[i]) OVER (PARTITION BY f, i) AS mean,
    stddev_pop(x[i]) OVER (PARTITION BY f, i) AS sd
  FROM b, range(-1, {NET_FOLDS}) folds(f), range(1, {NET_P + 1}) places(i) WHERE fold <> f),
st AS (SELECT f, patient, i, y, (v - mean) / sd AS z FROM tr),
gram AS (SELECT f, i, list(r ORDER BY j) AS row FROM (SELECT f, a.i, b.i AS j, avg(a.z * b.z) AS r FROM st a JOIN st b USING (f, patient)
    GROUP BY f, a.i, b.i) GROUP BY f, i),
k AS (SELECT f, list(c ORDER BY i) AS c FROM (SELECT f, i, avg(z * y) AS c FROM st GROUP BY f, i) GROUP BY f),
s0 AS (SELECT f, (c[1] - row[2] * c[2]) / (1 - row[2] * row[2]) AS b1, (c[2] - row[2] * c[1]) / (1 - row[2] * row[2]) AS b2, c
  FROM k JOIN gram USING (f) WHERE i = 1),
lam AS (SELECT {NET_SHARE} * max(abs(c[i] - row[1] * b1 - row[2] * b2)) / 0.5 AS lam FROM s0 JOIN gram USING (f) WHERE f = -1 AND i > 2),
cd AS (SELECT f, 0 AS step, CAST(list_concat([b1, b2], list_transform(range({NET_P - 2}), lambda q: 0.0)) AS DOUBLE[]) AS beta FROM s0
  UNION ALL SELECT f, step + 1, list_transform(beta, lambda v, q: CASE WHEN q = j THEN new ELSE v END)
  FROM (SELECT f, step, beta, j, sign(r) * greatest(abs(r) - soft, 0) / (1 + soft) AS new
    FROM (SELECT cd.f, step, beta, i AS j, c[i] - list_dot_product(row, beta) + beta[i] AS r, CASE WHEN i > 2 THEN 0.5 * lam ELSE 0.0 END AS soft
      FROM cd JOIN gram g ON g.f = cd.f AND g.i = step % {NET_P} + 1 JOIN k ON k.f = cd.f, lam WHERE step < {NET_P * NET_SWEEPS}))),
co AS (SELECT DISTINCT f, i, beta[i] / sd AS slope, mean FROM tr JOIN (SELECT f, beta FROM cd WHERE step = {NET_P * NET_SWEEPS}) USING (f)),
ic AS (SELECT f, my - sum(slope * mean) AS intercept FROM co JOIN (
    SELECT f, avg(b.y) AS my FROM b, range(-1, {NET_FOLDS}) folds(f) WHERE fold <> f GROUP BY f) USING (f) GROUP BY f, my),
er AS (SELECT fold, count(*) AS n, sum(pow(y - intercept - fit, 2)) AS sse FROM (
    SELECT b.patient, any_value(fold) AS fold, any_value(b.y) AS y, sum(slope * x[i]) AS fit FROM b JOIN co ON co.f = b.fold GROUP BY b.patient)
  JOIN ic ON ic.f = fold GROUP BY fold),
cv AS (SELECT sum(n) AS n, sum(sse) / sum(n) AS e FROM er)"""


def net(t):
    path, terms = elastic_net.moderator_net(t["fx_baseline"], NET_NUMERIC, NET_FACTORS, NET_PRE, "score_post", "grp", folds=NET_FOLDS,
                                            lambdas=3, least_share=NET_SHARE**2)
    return path.withColumn("here", F.abs(F.col("share") - NET_SHARE) < 1e-9), terms


@query("moderator_net", NET + """
SELECT CASE WHEN i = 0 THEN '(Intercept)' ELSE terms[i] END AS term, estimate, lam AS penalty FROM (
  SELECT i, slope AS estimate FROM co WHERE f = -1 UNION ALL SELECT 0, intercept FROM ic WHERE f = -1), lam,
  (SELECT [""" + ", ".join(f"'{x}'" for x in NET_TERMS) + """] AS terms)""", doubles=["estimate", "penalty"], digits=5)
def moderator_net(t):
    path, terms = net(t)
    return elastic_net.net_coefficients(path, terms, rule="here")


@query("moderator_net_cv", NET + """
SELECT lam AS penalty, CAST(n AS BIGINT) AS n_obs, (SELECT CAST(count(*) AS INT) FROM co WHERE f = -1 AND slope <> 0) AS n_nonzero, e AS cv_error,
  sqrt((SELECT sum(er.n * pow(sse / er.n - e, 2)) FROM er) / n / (SELECT count(*) - 1 FROM er)) AS cv_se FROM cv, lam""",
       doubles=["penalty", "cv_error", "cv_se"], digits=4)
def moderator_net_cv(t):
    return net(t)[0].where("here").select("penalty", "n_obs", "n_nonzero", "cv_error", "cv_se")


# --- whole study ------------------------------------------------------------------------------

def study(t):
    """A study whose questionnaires are views over the orders."""
    forms = {"ZBI": t["fx_items"], "WHO-5": t["fx_wellbeing"], "BDI-II": t["fx_depression"]}
    return Study(t["fx_people"], forms, t["fx_case_form"], seq_col="tie")


W_ITEMS = [f"id{i}_w" for i in range(1, 6)]
D_ITEMS = [f"id{k}_{k}" for k in range(1, 13)]


def known_sql(items):
    return " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in items)


def total_sql(items):
    return " + ".join(f"coalesce({c}, 0.0)" for c in items)


FORMS = rows.CODED + ", wb AS (SELECT patient, authored, tie, " + ", ".join(
    f"{rows.code_sql(c, text.WELLBEING_CODES)} AS {c}" for c in W_ITEMS) + " FROM {fx_wellbeing}), dp AS (SELECT patient, authored, tie, " + ", ".join(
    f"{rows.number_sql(c)} AS {c}" for c in D_ITEMS) + f""" FROM {{fx_depression}}),
scored AS (
  SELECT 'ZBI' AS instrument, patient, authored, tie,
    CASE WHEN {known_sql(rows.ITEMS)} >= 2 THEN ({total_sql(rows.ITEMS)}) / nullif({known_sql(rows.ITEMS)}, 0) * 6 END AS score FROM coded
  UNION ALL SELECT 'WHO-5', patient, authored, tie,
    CASE WHEN {known_sql(W_ITEMS)} >= 4 THEN ({total_sql(W_ITEMS)}) / ({known_sql(W_ITEMS)}) * 20 END FROM wb
  UNION ALL SELECT 'BDI-II', patient, authored, tie,
    CASE WHEN {known_sql(D_ITEMS)} >= 10 THEN ({total_sql(D_ITEMS)}) / ({known_sql(D_ITEMS)}) * 12 END FROM dp),
numbered AS (SELECT *, row_number() OVER (PARTITION BY instrument, patient ORDER BY authored, tie) AS rn,
    count(*) OVER (PARTITION BY instrument, patient) AS n FROM scored),
sp AS (SELECT s.instrument, s.patient, CASE WHEN coalesce(p.active, FALSE) THEN 'Intervention' ELSE 'Control' END AS grp,
    max(CASE WHEN rn = 1 THEN score END) AS pre, max(CASE WHEN rn = n THEN score END) AS post
  FROM numbered s JOIN {{fx_people}} p ON p.patient_id = s.patient WHERE n > 1 GROUP BY s.instrument, s.patient, p.active),
sk AS (SELECT *, post - pre AS change, (pre + post) / 2 AS lvl FROM sp WHERE post - pre IS NOT NULL)
"""


@query("study_pairs", FORMS + """
SELECT CAST(patient AS VARCHAR) AS patient, instrument, grp AS "group", pre, post, post - pre AS change FROM sp""",
       doubles=["pre", "post", "change"])
def study_pairs(t):
    return study(t).pairs


@query("study_anova", FORMS + anova_steps("sk", "tests") + "SELECT * FROM tests", doubles=ANOVA_DOUBLES)
def study_anova(t):
    return study(t).anova()


DEP_LABELS = ", dl AS (SELECT patient, authored, " + ", ".join(
    f"{rows.likert_sql(c, text.DEPRESSION_CODES)} AS {c}" for c in D_ITEMS) + " FROM {fx_depression})"


@query("study_baseline_rows", rows.CODED + DEP_LABELS + f"""
, z AS (SELECT c.patient, c.authored, c.tie, CASE WHEN 6 - ({known_sql(rows.ITEMS)}) <= 4 THEN {total_sql(rows.ITEMS)} END AS zbi_total_raw
  FROM coded c),
b AS (SELECT patient, authored, CASE WHEN 12 - ({known_sql(D_ITEMS)}) <= 2 THEN {total_sql(D_ITEMS)} END AS bdi_total_raw FROM dl),
j AS (SELECT z.*, b.bdi_total_raw, row_number() OVER (PARTITION BY z.patient ORDER BY z.authored, z.tie, z.zbi_total_raw NULLS FIRST,
    b.bdi_total_raw NULLS FIRST) AS rn FROM z LEFT JOIN b ON b.patient = z.patient AND b.authored = z.authored)
SELECT CAST(j.patient AS VARCHAR) AS patient_id, zbi_total_raw, bdi_total_raw, CASE WHEN zbi_total_raw <= 20 THEN 'keine/geringe'
    WHEN zbi_total_raw <= 40 THEN 'leicht' END AS zbi_kat_raw, CAST(20 + j.patient % 70 AS DOUBLE) AS alter,
  {rows.SEX} AS geschlecht, {rows.MARITAL} AS familienstand,
  CASE WHEN coalesce(p.active, FALSE) THEN 'Intervention' ELSE 'Control' END AS "group"
FROM j JOIN {{fx_demographics}} d ON d.patient = j.patient JOIN {{fx_people}} p ON p.patient_id = j.patient WHERE rn = 1""")
def study_baseline_rows(t):
    return study(t).baseline_rows().select("patient_id", "zbi_total_raw", "bdi_total_raw", "zbi_kat_raw", "alter",
                                           "geschlecht", "familienstand", "group")
