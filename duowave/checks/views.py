"""Study-shaped views over the test tables; the same SELECT text runs in Spark and in DuckDB.

The tables have no missing cells, so the views blank some out. Patients without an entry in the
dimension are those who never made a purchase above 75.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duowave.operators.mice import COPIES
from duowave.sources.exports import scan_parquet

VIEWS = {
    "fx_patients": """
SELECT user_id AS patient_id,
  CASE WHEN user_id % 7 = 0 THEN NULL ELSE user_id % 2 = 0 END AS active
FROM {events}
GROUP BY user_id
HAVING max(CASE WHEN event_type = 'purchase' THEN value END) > 75""",
    "fx_visits": """
SELECT user_id AS patient, event_type AS instrument, ts AS when_dt, event_id AS tie,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS score
FROM {events}""",
    "fx_items": """
SELECT o_custkey AS patient, o_orderdate AS authored, o_orderkey AS tie,
  CASE o_orderkey % 9 WHEN 0 THEN 'Nie' WHEN 1 THEN ' selten ' WHEN 2 THEN 'manchmal' WHEN 3 THEN '3 - häufig'
    WHEN 4 THEN 'FAST  immer' WHEN 5 THEN '2' WHEN 6 THEN 'NULL' WHEN 7 THEN NULL ELSE 'unbekannt' END AS id1_1_a,
  CASE (o_orderkey * 3) % 7 WHEN 0 THEN 'nie' WHEN 1 THEN 'oft' WHEN 2 THEN 'immer' WHEN 3 THEN NULL ELSE '1' END AS id2_2_b,
  CASE (o_orderkey * 5) % 11 WHEN 0 THEN 'NaN' WHEN 1 THEN '4' WHEN 2 THEN '1,5' WHEN 3 THEN '' ELSE 'selten' END AS id3_3_c,
  CASE (o_orderkey * 7) % 5 WHEN 0 THEN 'meistens' WHEN 1 THEN 'Häufig' ELSE '0' END AS id4_4_d,
  CASE (o_orderkey * 2) % 13 WHEN 0 THEN NULL WHEN 1 THEN 'NA' ELSE 'manchmal' END AS id5_5_e,
  CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE 'ziemlich oft' END AS id6_6_f
FROM {orders}""",
    "fx_dates": """
SELECT o_orderkey AS id, o_custkey AS patient, o_orderdate AS true_date,
  CASE o_orderkey % 5
    WHEN 0 THEN concat(year(o_orderdate), '-', month(o_orderdate), '-', day(o_orderdate))
    WHEN 1 THEN concat(day(o_orderdate), '.', month(o_orderdate), '.', year(o_orderdate))
    WHEN 2 THEN concat(day(o_orderdate), '.', month(o_orderdate), '.', year(o_orderdate), ' 07:05')
    WHEN 3 THEN concat(month(o_orderdate), '/', day(o_orderdate), '/', year(o_orderdate))
    ELSE 'unbekannt' END AS raw_date,
  CAST(CASE WHEN o_orderkey % 6 = 0 THEN 9999.0 ELSE 30000.0 + o_orderkey % 20000 + 0.5 END AS DOUBLE) AS serial
FROM {orders}""",
    "fx_demographics": """
SELECT c_custkey AS patient,
  CASE c_custkey % 8 WHEN 0 THEN 'w' WHEN 1 THEN 'Female' WHEN 2 THEN ' M ' WHEN 3 THEN 'männlich'
    WHEN 4 THEN 'divers' WHEN 5 THEN 'nb' WHEN 6 THEN NULL ELSE 'x' END AS sex_raw,
  CASE c_custkey % 6 WHEN 0 THEN 'ledig' WHEN 1 THEN 'Verheiratet/ eingetragene Lebenspartnerschaft'
    WHEN 2 THEN 'geschieden' WHEN 3 THEN 'verwitwet' WHEN 4 THEN NULL ELSE 'andere' END AS marital_raw,
  CASE WHEN c_custkey % 17 = 0 THEN 'k.A.' ELSE CAST(20 + c_custkey % 70 AS VARCHAR(8)) END AS age_raw,
  CASE WHEN c_custkey % 2 = 0 THEN 'Intervention' ELSE 'Control' END AS grp,
  c_mktsegment AS segment, c_acctbal AS acctbal
FROM {customer}""",
    "fx_baseline": """
SELECT c.c_custkey AS patient,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'Intervention' ELSE 'Control' END AS grp,
  CASE WHEN c.c_custkey % 19 = 0 THEN NULL ELSE f.o_totalprice / 1000 END AS score_pre,
  CASE WHEN c.c_custkey % 23 = 0 THEN NULL ELSE l.o_totalprice / 1000 END AS score_post,
  CASE WHEN c.c_custkey % 13 = 0 THEN NULL ELSE c.c_acctbal END AS acctbal,
  CAST(v.n_orders AS DOUBLE) AS n_orders,
  c.c_mktsegment AS segment, r.r_name AS region
FROM {customer} c
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
JOIN (SELECT o_custkey, count(*) AS n_orders, min(o_orderkey) AS k0, max(o_orderkey) AS k1
      FROM {orders} GROUP BY o_custkey) v ON v.o_custkey = c.c_custkey
JOIN {orders} f ON f.o_orderkey = v.k0
JOIN {orders} l ON l.o_orderkey = v.k1""",
    "fx_people": """
SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 2 = 0 END AS active
FROM {customer}""",
    "fx_wellbeing": "SELECT o_custkey AS patient, o_orderdate AS authored, o_orderkey AS tie, " + ", ".join(
        f"CASE (o_orderkey * {k} + o_custkey) % 8 WHEN 0 THEN 'Die ganze Zeit' WHEN 1 THEN 'Meistens' "
        "WHEN 2 THEN 'Etwas mehr als die Hälfte der Zeit' WHEN 3 THEN 'Etwas weniger als die  Hälfte der Zeit' "
        f"WHEN 4 THEN 'Ab und zu' WHEN 5 THEN ' nie ' WHEN 6 THEN '3' END AS id{i}_w"
        for i, k in enumerate((1, 3, 5, 7, 9), 1)) + " FROM {orders}",
    "fx_depression": "SELECT o_custkey AS patient, o_orderdate AS authored, o_orderkey AS tie, " + ", ".join(
        f"CASE (o_orderkey * {k} + o_custkey) % 11 WHEN 0 THEN '0' WHEN 1 THEN '1 - leicht' WHEN 2 THEN '2' WHEN 3 THEN '3' "
        f"WHEN 4 THEN 'oft' WHEN 5 THEN '1' WHEN 6 THEN '0 - nie' WHEN 7 THEN '2' WHEN 8 THEN '1' WHEN 9 THEN '3' END AS id{k}_{k}"
        for k in range(1, 13)) + ", 'Freitext 99' AS id25_1 FROM {orders}",
    "fx_case_form": """
SELECT patient, patient AS tie, CAST(20 + patient % 70 AS VARCHAR(8)) AS id1_1_ihr_alter, sex_raw AS id2_2_ihr_geschlecht,
  marital_raw AS id3_3_ihr_familienstand, CAST(acctbal AS VARCHAR(20)) AS id117_wie_viele_stunden_sind_s_ie_in_der_woche_erwerbstatig_angabe_als_dezimalzahl_z_b_1_5
FROM {fx_demographics}""",
    "fx_imputed": """
SELECT imp, patient, grp, 'price' AS instrument,
  coalesce(score_pre, 100.0 + (patient * 31 + imp * 17) % 200) AS pre,
  coalesce(score_post, 100.0 + (patient * 37 + imp * 29) % 200) AS post
FROM {fx_copies}""",
}

# Text after preparation, as scoring and summaries need it.
ITEM_COLUMNS = ["id1_1_a", "id2_2_b", "id3_3_c", "id4_4_d", "id5_5_e", "id6_6_f"]


def _parents(body: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", body)))


class Tables:
    """The test tables and the views over them as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        if name == "fx_copies":
            return self["fx_baseline"].withColumn("imp", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
        if name in VIEWS:
            body = VIEWS[name]
            return self.spark.sql(body, **{p: self[p] for p in _parents(body)})
        return scan_parquet(self.spark, self.folder, name)


# Steps shared by several SQL twins, in terms of the views.
STEPS = {
    "fx_copies": "SELECT *, unnest(range(1, 21)) AS imp FROM {fx_baseline}",
    "arms": """
SELECT patient_id, CASE WHEN coalesce(active, FALSE) THEN 'Intervention' ELSE 'Control' END AS grp
FROM {fx_patients}""",
    "long": """
SELECT v.patient, v.instrument, v.when_dt, v.tie, v.score, a.grp,
  CASE WHEN v.rn = 1 THEN 'pre' ELSE 'post' END AS time
FROM (SELECT *, row_number() OVER (PARTITION BY instrument, patient ORDER BY when_dt, tie) AS rn,
        count(*) OVER (PARTITION BY instrument, patient) AS n
      FROM {fx_visits} WHERE when_dt IS NOT NULL) v
LEFT JOIN {arms} a ON a.patient_id = v.patient
WHERE v.n > 1 AND (v.rn = 1 OR v.rn = v.n)""",
    "pairs": """
SELECT instrument, patient, grp, pre, post, post - pre AS change
FROM (SELECT instrument, patient, grp, max(CASE WHEN time = 'pre' THEN score END) AS pre,
        max(CASE WHEN time = 'post' THEN score END) AS post
      FROM {long} GROUP BY instrument, patient, grp) w""",
    "labels_raw": "SELECT patient, authored, tie, " + ", ".join(
        f"CASE WHEN trim({c}) NOT IN ('', 'NA', 'NaN', 'NULL') THEN trim({c}) END AS {c}" for c in ITEM_COLUMNS
    ) + " FROM {fx_items}",
}


def common_table_expressions(names: list[str]) -> str:
    """WITH clause that defines the named steps and all they build on."""
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        body = STEPS.get(name) or VIEWS.get(name)
        if body is None or name in done:
            return
        for parent in _parents(body):
            visit(parent)
        done[name] = re.sub(r"\{(\w+)\}", r"\1", body).strip()

    for name in names:
        visit(name)
    return ",\n".join(f"{name} AS (\n{body}\n)" for name, body in done.items())
