"""Queries on sources, columns, scalars, scores and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from duowave.checks.registry import query
from duowave.checks.views import ITEM_COLUMNS, Tables
from duowave.functions import categories as cat
from duowave.functions import dates, names, text
from duowave.operators import joins, linear, scoring
from duowave.operators import summary as tables
from duowave.operators.visits import first_by_key, pre_post_pairs
from duowave.plans.scratch import Scratch
from duowave.sources import exports

ITEMS = ITEM_COLUMNS


def pairs(t: Tables):
    """First and last scores per patient and instrument."""
    return pre_post_pairs(t["fx_visits"], ["patient", "instrument"], "when_dt", "tie")


def typed_items(t: Tables):
    """Item texts with the missing-value tokens removed."""
    return scoring.apply_across(t["fx_items"], ITEMS, text.blank_to_null)


def coded_items(t: Tables):
    """Items as codes of the default burden map."""
    return scoring.code_items(typed_items(t), ITEMS, text.BURDEN_CODES)


# --- SQL pieces -------------------------------------------------------------------------------

NUMBER_SQL = r"-?(?:\d[\d,]*(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"


def label_sql(c: str) -> str:
    return rf"lower(trim(regexp_replace({c}, '\s+', ' ', 'g')))"


def number_sql(c: str) -> str:
    return f"try_cast(nullif(replace(regexp_extract({c}, '{NUMBER_SQL}'), ',', ''), '') AS DOUBLE)"


def code_sql(c: str, codes: dict) -> str:
    branches = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in codes.items())
    return f"CAST(CASE {label_sql(c)} {branches} END AS DOUBLE)"


def likert_sql(c: str, codes: dict) -> str:
    return f"coalesce({number_sql(label_sql(c))}, {code_sql(c, codes)})"


CODED = ", coded AS (SELECT patient, authored, tie, " + ", ".join(
    f"{likert_sql(c, text.BURDEN_CODES)} AS {c}" for c in ITEMS) + " FROM {labels_raw})"
N_MISS = " + ".join(f"CAST({c} IS NULL AS INT)" for c in ITEMS)
N_ANS = " + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in ITEMS)
SUM = " + ".join(f"coalesce({c}, 0.0)" for c in ITEMS)


# --- sources ----------------------------------------------------------------------------------

@query("scan_parquet", """
SELECT event_type, count(*) AS n_rows, count(DISTINCT user_id) AS n_patients, max(event_id) AS last_id
FROM events GROUP BY event_type""")
def scan_parquet(t):
    return t["events"].groupBy("event_type").agg(
        F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_patients"),
        F.max("event_id").alias("last_id"))


def _exported(t: Tables, label: str) -> str:
    """Items written as CSV with spaced headers, umlauts and a quoted line break."""
    path = f"{Scratch(t.spark, label).path}/items.csv"
    items = t["fx_items"]
    (items.select(
        F.col("patient").alias("Patient ID"), F.col("tie").alias("Laufende Nr."),
        *[F.col(c).alias(f"ID{i} {i} Größe") for i, c in enumerate(ITEMS, 1)],
        F.concat(F.lit("erste Zeile\nzweite "), F.col("tie").cast("string")).alias("Bemerkung"),
    ).write.option("header", True).option("emptyValue", "").csv(path))
    return path


@query("read_export", """
SELECT CAST(patient AS VARCHAR) AS patient_id, CAST(tie AS DOUBLE) AS laufende_nr,
  """ + ", ".join(f"{c} AS id{i}_{i}_grosse" for i, c in enumerate(ITEMS, 1)) + """,
  length(concat('erste Zeile zweite ', tie)) AS note_length
FROM {labels_raw}""")
def read_export(t):
    df = exports.read_export(t.spark, _exported(t, "export"), {"laufende_nr": T.DoubleType()})
    return df.select(F.col("patient_id").cast("string"), "laufende_nr", *[f"id{i}_{i}_grosse" for i in range(1, 7)],
                     F.length("bemerkung").cast("long").alias("note_length"))


@query("write_csv", """
SELECT grp, count(*) AS n, sum(CASE WHEN acctbal > 0 THEN 1 ELSE 0 END)::BIGINT AS in_credit
FROM {fx_demographics} GROUP BY grp""")
def write_csv(t):
    path = f"{Scratch(t.spark, 'sink').path}/groups"
    exports.write_csv(t["fx_demographics"].groupBy("grp").agg(
        F.count("*").alias("n"), F.count_if(F.col("acctbal") > 0).alias("in_credit")), path)
    return t.spark.read.schema("grp string, n long, in_credit long").option("header", True).csv(path)


COEFFICIENT_SCHEMA = T.StructType([
    T.StructField(c, T.StringType() if c in ("outcome", "predictor", "model", "term") else
                  T.LongType() if c in ("n_obs", "dof") else T.DoubleType()) for c in linear.COEFFICIENT_COLUMNS])


@query("read_result_checked", """
SELECT 'score_pre' AS outcome, 'n_orders' AS predictor, regr_slope(score_pre, n_orders) AS estimate,
  regr_count(score_pre, n_orders)::BIGINT AS n_obs
FROM {fx_baseline}""", doubles=["estimate"])
def read_result_checked(t):
    path = f"{Scratch(t.spark, 'result').path}/coefficients"
    exports.write_csv(linear.uni_lm_numeric(t["fx_baseline"], ["score_pre"], ["n_orders"]), path)
    return exports.read_result_checked(
        t.spark, path, COEFFICIENT_SCHEMA,
        ["estimate", "conf_low", "conf_high", "p_value", "outcome", "predictor"],
    ).select("outcome", "predictor", "estimate", "n_obs")


# --- columns, projections, filters ------------------------------------------------------------

@query("standardize_id", "SELECT trim(CAST(patient AS VARCHAR)) AS patient_id, sex_raw FROM {fx_demographics}")
def standardize_id(t):
    return names.standardize_id(t["fx_demographics"].select("patient", "sex_raw"))


@query("detect_id_column", "SELECT CAST(patient_id AS VARCHAR) AS id, active FROM {fx_patients}")
def detect_id_column(t):
    df = t["fx_patients"]
    return df.select(F.col(names.detect_id_column(df)).cast("string").alias("id"), "active")


@query("clean_names", "SELECT patient AS patient_id, sex_raw AS geschlecht_w_m, marital_raw AS familienstand_2 FROM {fx_demographics}")
def clean_names(t):
    spaced = t["fx_demographics"].select(
        F.col("patient").alias("Patient ID"), F.col("sex_raw").alias("Geschlecht (w/m)"),
        F.col("age_raw").alias("Familienstand"), F.col("marital_raw").alias("familienstand!"))
    return names.clean_names(spaced).drop("familienstand")


@query("select_items", """
SELECT tie, """ + " + ".join(f"CAST({c} IS NULL AS INT)" for c in ITEMS if c != "id4_4_d") + """ AS n_empty FROM {fx_items}""")
def select_items(t):
    df = t["fx_items"]
    items = names.select_items(df, r"^id\d{1,2}_\d+", exclude=r"^id4_")
    return names.require_columns(df, ["tie", *items]).select("tie", scoring.row_missing(items).alias("n_empty"))


@query("require_columns", "SELECT patient, sex_raw FROM {fx_demographics}")
def require_columns(t):
    return names.require_columns(t["fx_demographics"], ["patient", "sex_raw"]).select("patient", "sex_raw")


@query("first_present_column", "SELECT patient, marital_raw AS value FROM {fx_demographics}")
def first_present_column(t):
    df = t["fx_demographics"]
    return df.select("patient", F.col(names.first_present_column(df, ["familienstand", "marital_raw", "sex_raw"])).alias("value"))


def _two_headers(t: Tables) -> str:
    """One table as two files whose columns stand in another order, with gaps, serial dates and offsets."""
    path = Scratch(t.spark, "headers").path
    rows = t["fx_demographics"].select(
        F.col("patient").alias("Patient"), F.when(F.col("patient") % 3 != 0, 20 + F.col("patient") % 70).alias("Alter"),
        (45000 + F.col("patient") + F.lit(0.5)).alias("Datum"),
        F.concat(F.lit("2025-03-30T23:30:00"), F.when(F.col("patient") % 2 == 0, "+02:00").otherwise("-0130")).alias("Authored"),
        F.lit("x").alias("Note"))
    odd = F.col("Patient") % 2 == 1
    rows.where(~odd).write.option("header", True).csv(f"{path}/a")
    rows.where(odd).select("Authored", "Alter", "Datum", "Patient").write.option("header", True).csv(f"{path}/b")
    return f"{path}/*"


@query("read_export_headers", """
SELECT patient, CASE WHEN patient % 3 <> 0 THEN (20 + patient % 70)::DOUBLE END AS age, 'alter' AS age_column,
  CASE WHEN patient % 2 = 0 THEN 'x' END AS note,
  epoch_ms(((45000 + patient + 0.5 - 25569) * 86400000)::BIGINT) AS serial_at,
  CASE WHEN patient % 2 = 0 THEN TIMESTAMP '2025-03-30 21:30:00' ELSE TIMESTAMP '2025-03-31 01:00:00' END AS authored_at
FROM {fx_demographics}""")
def read_export_headers(t):
    df = exports.read_export(t.spark, _two_headers(t))
    age = tables.pick_plausible_column(df)
    return df.select("patient", text.to_numeric(age).alias("age"), F.lit(age).alias("age_column"), "note",
                     dates.parse_any_datetime(df, "datum").alias("serial_at"),
                     dates.parse_any_datetime(df, "authored").alias("authored_at"))


@query("unparsed_times", """
SELECT 'raw_date' AS column_name, count(raw_date)::BIGINT AS n_known,
  count(CASE WHEN raw_date = 'unbekannt' THEN 1 END)::BIGINT AS n_unparsed FROM {fx_dates}
UNION ALL SELECT 'serial', count(serial)::BIGINT, count(CASE WHEN serial <= 10000 OR serial >= 80000 THEN 1 END)::BIGINT FROM {fx_dates}""")
def unparsed_times(t):
    return dates.unparsed_times(t["fx_dates"], ["raw_date", "serial"])


@query("present_columns", "SELECT patient, sex_raw AS sex FROM {fx_demographics}")
def present_columns(t):
    df = t["fx_demographics"]
    sex = names.first_present_column(df, ["geschlecht", "sex_raw", "marital_raw"])
    return df.select(*names.present_columns(df, ["patient", "patient_id", "visit"]), F.col(sex).alias("sex"))


def _ages(t):
    return t["fx_demographics"].select(
        "patient", F.col("age_raw").alias("alter_text"), F.col("acctbal").alias("age_account"),
        (F.lit(20) + F.col("patient") % 70).alias("alter_jahre"),
        (F.lit(1940) + F.col("patient") % 60).cast("string").alias("geburtsjahr"))


AGES = """
, ages AS (SELECT patient, age_raw AS alter_text, acctbal AS age_account, 20 + patient % 70 AS alter_jahre,
    CAST(1940 + patient % 60 AS VARCHAR) AS geburtsjahr FROM {fx_demographics}),
cells AS (
  SELECT 'alter_text' AS column_name, 1 AS position, FALSE AS is_number, try_cast(alter_text AS DOUBLE) AS x FROM ages
  UNION ALL SELECT 'age_account', 2, TRUE, age_account FROM ages
  UNION ALL SELECT 'alter_jahre', 3, TRUE, alter_jahre FROM ages
  UNION ALL SELECT 'geburtsjahr', 4, FALSE, try_cast(geburtsjahr AS DOUBLE) FROM ages),
profile AS (
  SELECT column_name, position, is_number, count(*) AS n_rows, count(x) AS n_numeric,
    count(x) / count(*)::DOUBLE AS numeric_share, median(x) AS median, stddev_samp(x) AS sd
  FROM cells GROUP BY column_name, position, is_number)
"""


@query("column_profile", AGES + "SELECT * FROM profile", doubles=["numeric_share", "median", "sd"])
def column_profile(t):
    return tables.column_profile(_ages(t), ["alter_text", "age_account", "alter_jahre", "geburtsjahr"])


@query("pick_plausible_column", AGES + """
SELECT column_name, position, n_numeric, CASE WHEN (is_number OR n_numeric = n_rows) AND n_numeric > 0 THEN
    CAST(coalesce(median BETWEEN 10 AND 110, FALSE) AS INT) + CAST(coalesce(sd > 0.5, FALSE) AS INT) END AS points,
  column_name = 'alter_jahre' AS is_best
FROM profile""")
def pick_plausible_column(t):
    ages = _ages(t)
    best = tables.pick_plausible_column(ages)
    profile = tables.column_profile(ages, ["alter_text", "age_account", "alter_jahre", "geburtsjahr"])
    return tables.plausibility(profile).select(
        "column_name", "position", "n_numeric", "points", (F.col("column_name") == best).alias("is_best"))


@query("find_column_by_token", r"""
SELECT * FROM (
  SELECT 'sex_raw' AS column_name, 1 AS position,
    bool_or(regexp_matches(lower(trim(sex_raw)), '\b(w|f|m|weiblich|männlich|maennlich|female|male|divers|non[- ]binary|nb)\b')) AS has_token
  FROM {fx_demographics}
  UNION ALL SELECT 'marital_raw', 2, bool_or(regexp_matches(lower(trim(marital_raw)), '\b(w|f|m|weiblich|männlich|maennlich|female|male|divers|non[- ]binary|nb)\b'))
  FROM {fx_demographics}
  UNION ALL SELECT 'age_raw', 3, bool_or(regexp_matches(lower(trim(age_raw)), '\b(w|f|m|weiblich|männlich|maennlich|female|male|divers|non[- ]binary|nb)\b'))
  FROM {fx_demographics})""")
def find_column_by_token(t):
    return tables.token_columns(t["fx_demographics"].select("sex_raw", "marital_raw", "age_raw"))


@query("project", """
SELECT patient AS patient_id, instrument AS scale, score FROM {fx_visits}""")
def project(t):
    return t["fx_visits"].withColumnsRenamed({"patient": "patient_id", "instrument": "scale"}).drop("when_dt", "tie")


@query("apply_across", CODED + "SELECT tie, " + ", ".join(ITEMS) + " FROM coded")
def apply_across(t):
    return coded_items(t).select("tie", *ITEMS)


@query("filter_rows", """
SELECT patient, instrument, tie, score FROM {fx_visits}
WHERE score IS NOT NULL AND instrument IN ('click', 'view', 'purchase') AND regexp_matches(instrument, '^(c|p)')""")
def filter_rows(t):
    return t["fx_visits"].where(
        F.col("score").isNotNull() & F.col("instrument").isin("click", "view", "purchase")
        & F.col("instrument").rlike("^(c|p)")).select("patient", "instrument", "tie", "score")


@query("group_label", "SELECT * FROM {arms}")
def group_label(t):
    return t["fx_patients"].select("patient_id", cat.group_label("active").alias("grp"))


@query("group_dummy", """
SELECT v.tie, CASE WHEN a.grp = 'Intervention' THEN 1 ELSE 0 END AS group_num
FROM {fx_visits} v LEFT JOIN {arms} a ON a.patient_id = v.patient""")
def group_dummy(t):
    return joins.join_group(t["fx_visits"], group_label(t)).select("tie", cat.group_dummy("grp").alias("group_num"))


@query("with_levels", """
SELECT patient, CASE WHEN segment IN ('BUILDING', 'MACHINERY') THEN segment END AS segment,
  CASE segment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 END AS segment_pos
FROM {fx_demographics}""")
def with_levels(t):
    return cat.with_levels(t["fx_demographics"].select("patient", "segment"), "segment", ["MACHINERY", "BUILDING"],
                           "segment_pos")


@query("add_literal", """
SELECT instrument, patient, change, 'ZBI' AS scale, CAST(NULL AS VARCHAR) AS review_note FROM {pairs}""",
       doubles=["change"])
def add_literal(t):
    return pairs(t).select("instrument", "patient", "change", F.lit("ZBI").alias("scale"),
                           F.lit(None).cast("string").alias("review_note"))


# --- scalars ----------------------------------------------------------------------------------

@query("normalize_label", "SELECT tie, " + ", ".join(f"{label_sql(c)} AS {c}" for c in ITEMS) + " FROM {fx_items}")
def normalize_label(t):
    return scoring.apply_across(t["fx_items"], ITEMS, text.normalize_label).select("tie", *ITEMS)


@query("parse_number", "SELECT tie, " + ", ".join(f"{number_sql(c)} AS {c}" for c in ITEMS) + " FROM {labels_raw}")
def parse_number(t):
    return scoring.apply_across(typed_items(t), ITEMS, text.parse_number).select("tie", *ITEMS)


@query("likert_code", "SELECT tie, " + ", ".join(
    [f"{likert_sql('id1_1_a', text.BURDEN_CODES)} AS burden", f"{likert_sql('id2_2_b', text.DEPRESSION_CODES)} AS depression",
     f"{code_sql('id4_4_d', text.WELLBEING_CODES)} AS wellbeing",
     f"{code_sql('id5_5_e', text.BURDEN_CODES_STRICT)} AS strict"]) + " FROM {labels_raw}")
def likert_code(t):
    df = typed_items(t).select("tie", F.col("id1_1_a").alias("burden"), F.col("id2_2_b").alias("depression"),
                               F.col("id4_4_d").alias("wellbeing"), F.col("id5_5_e").alias("strict"))
    df = scoring.code_items(df, ["burden"], text.BURDEN_CODES)
    df = scoring.code_items(df, ["depression"], text.DEPRESSION_CODES)
    df = scoring.code_items(df, ["wellbeing"], text.WELLBEING_CODES, number_first=False)
    return scoring.code_items(df, ["strict"], text.BURDEN_CODES_STRICT, number_first=False)


@query("to_numeric", r"""
SELECT patient, CASE WHEN regexp_matches(age_raw, '^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$')
  THEN try_cast(age_raw AS DOUBLE) END AS age FROM {fx_demographics}""")
def to_numeric(t):
    return t["fx_demographics"].select("patient", text.to_numeric("age_raw").alias("age"))


PARSED = """
CASE id % 5 WHEN 4 THEN NULL WHEN 2 THEN strptime(raw_date, '%d.%m.%Y %H:%M') WHEN 0 THEN strptime(raw_date, '%Y-%m-%d')
  WHEN 1 THEN strptime(raw_date, '%d.%m.%Y')
  ELSE coalesce(try_strptime(raw_date, '%d/%m/%Y'), try_strptime(raw_date, '%m/%d/%Y')) END"""


@query("parse_any_datetime", "SELECT id, " + PARSED + " AS when_dt FROM {fx_dates}")
def parse_any_datetime(t):
    df = t["fx_dates"]
    return df.select("id", dates.parse_any_datetime(df, "raw_date").alias("when_dt"))


SERIAL = "CASE WHEN serial > 10000 AND serial < 80000 THEN epoch_ms(CAST((serial - 25569) * 86400000 AS BIGINT)) END"


@query("excel_serial", f"SELECT id, {SERIAL} AS when_dt FROM {{fx_dates}}")
def excel_serial(t):
    df = t["fx_dates"]
    return df.select("id", dates.parse_any_datetime(df, "serial").alias("when_dt"))


@query("coalesce_columns", f"SELECT id, coalesce({PARSED}, {SERIAL}) AS when_dt FROM {{fx_dates}}")
def coalesce_columns(t):
    df = t["fx_dates"]
    return df.select("id", F.coalesce(dates.parse_any_datetime(df, "raw_date"),
                                      dates.parse_any_datetime(df, "serial")).alias("when_dt"))


SEX = """CASE WHEN lower(trim(sex_raw)) IN ('w', 'f', 'weiblich', 'female', 'frau') THEN 'weiblich'
  WHEN lower(trim(sex_raw)) IN ('m', 'male', 'männlich', 'maennlich', 'mann') THEN 'männlich'
  WHEN lower(trim(sex_raw)) IN ('divers', 'd', 'non-binary', 'non binary', 'nb') THEN 'divers' END"""
MARITAL = """CASE WHEN lower(trim(marital_raw)) LIKE '%ledig%' THEN 'Ledig'
  WHEN regexp_matches(lower(trim(marital_raw)), 'verheiratet|lebenspartnerschaft|eingetragene') THEN 'Verheiratet'
  WHEN lower(trim(marital_raw)) LIKE '%geschieden%' THEN 'Geschieden'
  WHEN lower(trim(marital_raw)) LIKE '%verwitwet%' THEN 'Verwitwet' ELSE 'Sonstiges' END"""


@query("canon_sex", f"SELECT patient, {SEX} AS sex FROM {{fx_demographics}}")
def canon_sex(t):
    return t["fx_demographics"].select("patient", text.canon_sex("sex_raw").alias("sex"))


@query("canon_marital", f"SELECT patient, {MARITAL} AS marital FROM {{fx_demographics}}")
def canon_marital(t):
    return t["fx_demographics"].select("patient", text.canon_marital("marital_raw").alias("marital"))


@query("bin_right_closed", """
SELECT patient, instrument, tie, CASE WHEN score <= 20 THEN 'keine/geringe' WHEN score <= 40 THEN 'leicht'
  WHEN score <= 60 THEN 'moderat' WHEN score > 60 THEN 'schwer' END AS band FROM {fx_visits}""")
def bin_right_closed(t):
    return t["fx_visits"].select("patient", "instrument", "tie", cat.bin_right_closed("score").alias("band"))


@query("severity_class", """
SELECT tie, CASE WHEN score <= 13 THEN 'minimal' WHEN score <= 19 THEN 'leicht' WHEN score <= 28 THEN 'moderat'
  WHEN score >= 29 THEN 'schwer' END AS severity FROM {fx_visits}""")
def severity_class(t):
    return t["fx_visits"].select("tie", cat.severity_class("score").alias("severity"))


@query("significance_label", """
SELECT tie, CASE WHEN score / 500 < 0.01 THEN 'p < .01' WHEN score / 500 < 0.05 THEN 'p < .05' ELSE 'n.s.' END AS sig
FROM {fx_visits}""")
def significance_label(t):
    return t["fx_visits"].select("tie", cat.significance_label(F.col("score") / 500).alias("sig"))


@query("term_label", """
SELECT patient, replace(concat('segment: ', segment), '_', ' ') AS label,
  CASE WHEN segment = 'BUILDING' THEN 'Building trade' ELSE concat('segment', segment) END AS mapped,
  concat('segment', segment) AS side_after, segment AS side_before
FROM {fx_demographics}""")
def term_label(t):
    terms = t["fx_demographics"].withColumns({"term": F.concat(F.lit("segment"), "segment"),
                                              "predictor": F.lit("segment")})
    return terms.select(
        "patient", cat.readable_term(F.col("term"), F.col("predictor")).alias("label"),
        cat.mapped_label(F.col("term"), {"segmentBUILDING": "Building trade"}, F.col("term")).alias("mapped"),
        cat.interaction_side(F.concat(F.lit("groupIntervention:"), "term")).alias("side_after"),
        cat.interaction_side(F.concat("segment", F.lit(":groupIntervention"))).alias("side_before"))


@query("format_interval", """
SELECT instrument, patient,
  CASE WHEN change IS NOT NULL THEN printf('%.2f [%.2f, %.2f]', change, change - 1, change + 1) END AS shown
FROM {pairs}""")
def format_interval(t):
    x = F.col("change")
    return pairs(t).select("instrument", "patient", text.format_interval(x, x - 1, x + 1).alias("shown"))


@query("math", """
SELECT o_orderkey AS id, abs(o_totalprice - 250000) AS gap, sqrt(o_totalprice) AS root, exp(o_totalprice / 1000000) AS growth,
  CAST(ceil(o_totalprice / 1000) AS BIGINT) AS thousands, round(o_totalprice / 1000, 2) AS rounded,
  o_totalprice - 1.96 * sqrt(o_totalprice) AS low,
  round(o_totalprice / pow(10, floor(log10(o_totalprice))), 2) * pow(10, floor(log10(o_totalprice))) AS three_digits
FROM orders""", doubles=["gap", "root", "growth", "low", "three_digits"], digits=4)
def math(t):
    x = F.col("o_totalprice")
    return t["orders"].select(
        F.col("o_orderkey").alias("id"), F.abs(x - 250000).alias("gap"), F.sqrt(x).alias("root"),
        F.exp(x / 1000000).alias("growth"), F.ceil(x / 1000).alias("thousands"), F.round(x / 1000, 2).alias("rounded"),
        (x - 1.96 * F.sqrt(x)).alias("low"), cat.signif(x, 3).alias("three_digits"))


@query("split_field", """
SELECT o_orderkey AS id, 1.0::DOUBLE AS df1, CAST(o_custkey AS DOUBLE) AS df2 FROM orders""")
def split_field(t):
    df1, df2 = text.split_field(F.concat(F.lit("1, "), F.col("o_custkey").cast("string")))
    return t["orders"].select(F.col("o_orderkey").alias("id"), df1.alias("df1"), df2.alias("df2"))


# --- row scores -------------------------------------------------------------------------------

@query("row_missing", CODED + f"SELECT tie, {N_MISS} AS n_missing, {N_ANS} AS n_answered FROM coded")
def row_missing(t):
    return coded_items(t).select("tie", scoring.row_missing(ITEMS).alias("n_missing"),
                                 scoring.row_answered(ITEMS).alias("n_answered"))


@query("row_sum", CODED + f"SELECT tie, {SUM} AS total FROM coded")
def row_sum(t):
    return coded_items(t).select("tie", scoring.row_sum(ITEMS).alias("total"))


@query("row_mean", CODED + f"SELECT tie, ({SUM}) / nullif({N_ANS}, 0) AS person_mean FROM coded",
       doubles=["person_mean"])
def row_mean(t):
    return coded_items(t).select("tie", scoring.row_mean(ITEMS).alias("person_mean"))


FILLED = ", filled AS (SELECT tie, " + ", ".join(
    f"CASE WHEN {c} IS NULL AND {N_MISS} <= 2 THEN ({SUM}) / nullif({N_ANS}, 0) ELSE {c} END AS {c}" for c in ITEMS
) + f", CASE WHEN {N_MISS} <= 2 THEN ({SUM}) / nullif({N_ANS}, 0) * 6 END AS total_imp, {N_MISS} AS n_miss, {SUM} AS total_obs FROM coded)"


@query("impute_scale", CODED + FILLED + "SELECT * EXCLUDE (n_miss, total_obs) FROM filled",
       doubles=[*ITEMS, "total_imp"])
def impute_scale(t):
    return scoring.impute_scale(coded_items(t), ITEMS, "total_imp", max_missing_count=2).select(
        "tie", *ITEMS, "total_imp")


@query("score_observed", CODED + f"SELECT tie, CASE WHEN {N_MISS} <= 1 THEN {SUM} END AS total FROM coded")
def score_observed(t):
    return coded_items(t).select("tie", scoring.score_observed(ITEMS, 1).alias("total"))


@query("score_prorated", CODED + f"SELECT tie, CASE WHEN {N_ANS} >= 5 THEN ({SUM}) / ({N_ANS}) * 6 END AS total FROM coded",
       doubles=["total"])
def score_prorated(t):
    return coded_items(t).select("tie", scoring.score_prorated(ITEMS).alias("total"))


@query("score_percent", CODED + f"SELECT tie, CASE WHEN {N_ANS} >= 4 THEN ({SUM}) / ({N_ANS}) * 5 * 4 END AS pct FROM coded",
       doubles=["pct"])
def score_percent(t):
    return coded_items(t).select("tie", scoring.score_percent(ITEMS).alias("pct"))


def scored_items(t):
    """Raw, imputed and preferred totals; raw comes first so that it stays raw."""
    raw = coded_items(t).withColumn("total_raw", scoring.score_observed(ITEMS, 3))
    return scoring.impute_scale(raw, ITEMS, "total_imp", max_missing_count=2).withColumn(
        "total_use", scoring.score_preferred("total_imp", "total_raw"))


SCORED = CODED + FILLED + """, scored AS (
  SELECT tie, CASE WHEN n_miss <= 3 THEN total_obs END AS total_raw, total_imp,
    coalesce(total_imp, CASE WHEN n_miss <= 3 THEN total_obs END) AS total_use FROM filled)
"""


@query("score_preferred", SCORED + "SELECT * FROM scored", doubles=["total_raw", "total_imp", "total_use"])
def score_preferred(t):
    return scored_items(t).select("tie", "total_raw", "total_imp", "total_use")


@query("keep_any_observed", """
SELECT patient, score_pre, score_post, acctbal FROM {fx_baseline}
WHERE coalesce(score_pre, score_post, acctbal) IS NOT NULL""", doubles=["score_pre", "score_post", "acctbal"])
def keep_any_observed(t):
    cols = ["score_pre", "score_post", "acctbal"]
    return scoring.keep_any_observed(t["fx_baseline"], cols).select("patient", *cols)


@query("missing_summary", SCORED + """
SELECT count(*) AS n_rows, count(*) FILTER (total_raw IS NULL) AS na_raw, count(*) FILTER (total_imp IS NULL) AS na_imp,
  count(*) FILTER (total_use IS NULL) AS na_use, count(*) FILTER (total_raw IS NULL AND total_imp IS NOT NULL) AS na_raw_imp_ok,
  count(*) FILTER (total_imp IS NULL) AS too_many_missing FROM scored""")
def missing_summary(t):
    return tables.missing_summary(scored_items(t), "total_raw", "total_imp", "total_use")


@query("missing_table", "SELECT score IS NULL AS is_missing, count(*) AS n FROM {fx_visits} GROUP BY 1")
def missing_table(t):
    return tables.missing_table(t["fx_visits"], "score")


# --- joins and distinct rows ------------------------------------------------------------------

@query("join_group", """
SELECT v.tie, v.patient, v.instrument, v.score, a.grp FROM {fx_visits} v LEFT JOIN {arms} a ON a.patient_id = v.patient""")
def join_group(t):
    return joins.join_group(t["fx_visits"].drop("when_dt"), group_label(t))


BURDEN_TOTALS = CODED + f""", burden AS (SELECT patient, authored, tie, CASE WHEN {N_MISS} <= 4 THEN {SUM} END AS burden FROM coded),
first_price AS (SELECT o_custkey AS patient, o_orderdate AS authored, o_orderkey AS price_id, o_totalprice AS price FROM orders)
"""


@query("join_two_keys", BURDEN_TOTALS + """
SELECT b.patient, b.authored, b.tie, b.burden, p.price_id, p.price
FROM burden b LEFT JOIN first_price p ON p.patient = b.patient AND p.authored = b.authored""")
def join_two_keys(t):
    left = coded_items(t).select("patient", "authored", "tie", scoring.score_observed(ITEMS, 4).alias("burden"))
    right = t["orders"].select(F.col("o_custkey").alias("patient"), F.col("o_orderdate").alias("authored"),
                               F.col("o_orderkey").alias("price_id"), F.col("o_totalprice").alias("price"))
    return joins.join_two_keys(left, right, ["patient", "authored"])


@query("join_chain", """
SELECT d.patient, d.sex_raw, b.score_pre, b.score_post, a.grp
FROM {fx_demographics} d LEFT JOIN {fx_baseline} b ON b.patient = d.patient LEFT JOIN {arms} a ON a.patient_id = d.patient""",
       doubles=["score_pre", "score_post"])
def join_chain(t):
    arms = group_label(t).withColumnRenamed("patient_id", "patient")
    return joins.join_chain(t["fx_demographics"].select("patient", "sex_raw"),
                            [t["fx_baseline"].select("patient", "score_pre", "score_post"), arms], "patient")


@query("distinct_rows", "SELECT DISTINCT sex_raw, marital_raw, grp FROM {fx_demographics}")
def distinct_rows(t):
    return t["fx_demographics"].select("sex_raw", "marital_raw", "grp").distinct()


@query("first_by_key", """
SELECT patient, tie, id1_1_a FROM (SELECT *, row_number() OVER (PARTITION BY patient ORDER BY tie) AS rn FROM {fx_items})
WHERE rn = 1""")
def first_by_key_query(t):
    return first_by_key(t["fx_items"].select("patient", "tie", "id1_1_a"), ["patient"], ["tie"])


@query("sort_rows", "SELECT patient, instrument, when_dt, tie, score FROM {fx_visits} ORDER BY patient, when_dt, tie")
def sort_rows(t):
    return t["fx_visits"].select("patient", "instrument", "when_dt", "tie", "score").orderBy("patient", "when_dt", "tie")
