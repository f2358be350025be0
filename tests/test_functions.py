import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from duowave.functions import categories as cat
from duowave.functions import dates, names, tails, text


def one(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_first_number_in_text(spark):
    texts = ["3 - häufig", "1,5", "1.234,5", "-2", "keine", "", None, "ca. .5 h", "2e3", "12.", "-", "10,000.5"]
    assert one(spark, texts, text.parse_number) == [3, 15, 1.234, -2, None, None, None, 0.5, 2000, 12, None, 10000.5]


def test_first_number_with_decimal_comma(spark):
    assert one(spark, ["1,5", "1.234,5"], lambda c: text.parse_number(c, decimal_comma=True)) == [1.5, 1234.5]


def test_whole_number_only(spark):
    assert one(spark, ["1,5", " 2 ", "1d", "NaN", "-3.5e1", "0x1", None], text.to_numeric) == [
        None, 2, None, None, -35, None, None]


def test_labels_and_numbers(spark):
    texts = ["Nie", " FAST   immer", "3 - häufig", "unbekannt", None, "Sehr\toft", "2"]
    assert one(spark, texts, lambda c: text.likert_code(c, text.BURDEN_CODES)) == [0, 4, 3, None, None, 4, 2]


def test_wellbeing_takes_labels_only(spark):
    texts = ["5", "Die ganze  Zeit", "etwas mehr als die Hälfte der Zeit"]
    assert one(spark, texts, lambda c: text.likert_code(c, text.WELLBEING_CODES, number_first=False)) == [None, 5, 3]


def test_number_wins_over_a_label_that_contains_another(spark):
    assert one(spark, ["3 mal"], lambda c: text.likert_code(c, {"3 mal": 1})) == [3]


def test_canonical_categories(spark):
    assert one(spark, ["W", " Mann", "nb", "x", None], text.canon_sex) == ["weiblich", "männlich", "divers", None, None]
    marital = ["Verheiratet/ eingetragene Lebenspartnerschaft", "ledig", "?", None]
    assert one(spark, marital, text.canon_marital) == ["Verheiratet", "Ledig", "Sonstiges", "Sonstiges"]


def test_datetime_texts(spark):
    texts = ["2025-10-13", "2025-10-13T09:54:12Z", "13.10.2025 09:54", "3/4/2025", "10/13/2025", "31.02.2025", "20251013",
             "2025/1/2 7:05", "x", None, "13.10.2025 09:54:59"]
    got = [None if v is None else v.isoformat(sep=" ") for v in one(spark, texts, dates.parse_datetime_text)]
    assert got == ["2025-10-13 00:00:00", "2025-10-13 09:54:12", "2025-10-13 09:54:00", "2025-04-03 00:00:00",
                   "2025-10-13 00:00:00", None, "2025-10-13 00:00:00", "2025-01-02 07:05:00", None, None,
                   "2025-10-13 09:54:59"]


def test_datetime_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = one(spark, ["2025-03-09 02:30"], lambda c: dates.parse_datetime_text(c).cast("string"))
        assert got == ["2025-03-09 02:30:00"]
        assert one(spark, [45000.5], lambda c: dates.excel_serial(c).cast("string"), "double") == ["2023-03-15 12:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_serial_bounds(spark):
    got = one(spark, [10000.0, 10000.5, 79999.0, 80000.0, None], dates.excel_serial, "double")
    assert [v is None for v in got] == [True, False, False, True, True]


def test_bands(spark):
    values = [20.0, 20.5, 60.0, 61.0, None]
    assert one(spark, values, cat.bin_right_closed, "double") == ["keine/geringe", "leicht", "moderat", "schwer", None]
    assert one(spark, [13.0, 28.0, 28.5, 29.0], cat.severity_class, "double") == ["minimal", "moderat", None, "schwer"]


def test_significant_digits(spark):
    got = one(spark, [0.0123456, 123456.0, -0.5, 0.0, None], cat.signif, "double")
    assert got[:4] == pytest.approx([0.0123, 123000, -0.5, 0.0]) and got[4] is None


def test_group_label_and_dummy(spark):
    assert one(spark, [True, False, None], cat.group_label, "boolean") == ["Intervention", "Control", "Control"]
    assert one(spark, ["Intervention", "Control", None], cat.group_dummy) == [1, 0, 0]


def test_term_texts(spark):
    df = spark.createDataFrame([("sexWeiblich", "sex"), ("years_known", "years_known")], "term string, predictor string")
    assert rows(df.select(cat.readable_term(F.col("term"), F.col("predictor")))) == [("sex: Weiblich",), ("years known",)]
    assert one(spark, ["groupIntervention:age", "age:groupIntervention"], cat.interaction_side) == ["age", "age"]


def test_declared_levels(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "x string")
    assert rows(cat.with_levels(df, "x", ["b", "a"], "pos")) == [("a", 2), (None, None), (None, None)]


def test_split_field(spark):
    assert one(spark, ["1, 48"], lambda c: F.array(*text.split_field(c))) == [[1.0, 48.0]]


def test_clean_names():
    headers = ["Patient ID", "Für wie viele?", "größeÄ", "createdAt", "2 Dinge", "__x__"]
    assert [names.clean_name(h) for h in headers] == [
        "patient_id", "fur_wie_viele", "grosse_a", "created_at", "x2_dinge", "x"]


def test_repeated_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A b` int, `a_b` int, `A-B` int")
    assert names.clean_names(df).columns == ["a_b", "a_b_2", "a_b_3"]


def test_column_resolution(spark):
    df = spark.createDataFrame([("1", "2", "3", "4")], "pid string, id1_1_a string, id25_2_b string, id3 string")
    assert names.detect_id_column(df) == "pid"
    assert names.select_items(df, r"^id\d{1,2}_\d+", exclude=r"^id25_") == ["id1_1_a"]
    assert names.select_items(df, r"^id\d+_x", fallback=r"^id\d+$") == ["id3"]
    assert names.first_present_column(df, ["sex", "gender"]) is None
    assert names.present_columns(df, ["id3", "nope", "pid"]) == ["id3", "pid"]
    with pytest.raises(ValueError):
        names.select_items(df, "^q")
    with pytest.raises(ValueError):
        names.require_columns(df, ["score"])
    with pytest.raises(ValueError):
        names.detect_id_column(df.select("id3"))


def test_tail_values():
    assert tails.t_quantile(0.975, [10.0])[0] == pytest.approx(2.228138852, abs=1e-9)
    assert float(tails.inc_beta(2, 3, 0.5)) == pytest.approx(0.6875, abs=1e-12)
    assert float(tails.t_tail(2.228138852, 10)) == pytest.approx(0.05, abs=1e-9)
    # One degree of freedom has the closed form of the arc tangent.
    t = np.array([0.0, 0.3, 1.0, 25.0])
    assert tails.t_tail(t, 1) == pytest.approx(1 - 2 * np.arctan(t) / math.pi, abs=1e-12)
    assert float(tails.t_tail(2.0, 1e7)) == pytest.approx(math.erfc(2 / math.sqrt(2)), abs=1e-6)


def test_tails_of_unknown_values(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (1.0, 0.0)], "t double, d double")
    got = [r[0] for r in df.select(tails.t_two_sided("t", "d")).collect()]
    assert got[0] == pytest.approx(0.363217468) and got[1:] == [None, None]


# The answer tables as they must be, written out a second time.
CODE_TABLES = {'BURDEN_CODES': {'zu keiner zeit': 0,
                  'nie': 0,
                  'selten': 1,
                  'manchmal': 2,
                  'häufig': 3,
                  'haeufig': 3,
                  'oft': 3,
                  'ziemlich oft': 3,
                  'sehr oft': 4,
                  'fast immer': 4,
                  'immer': 4,
                  'trifft nicht zu': 0,
                  'nie/überhaupt nicht': 0,
                  'gelegentlich': 2,
                  'hin und wieder': 2,
                  'häufig/oft': 3,
                  'ziemlich häufig': 3,
                  'sehr häufig': 4,
                  'meistens': 4},
 'BURDEN_CODES_STRICT': {'zu keiner zeit': 0,
                         'nie': 0,
                         'selten': 1,
                         'manchmal': 2,
                         'ziemlich oft': 3,
                         'fast immer': 4},
 'WELLBEING_CODES': {'die ganze zeit': 5,
                     'meistens': 4,
                     'etwas mehr als die hälfte der zeit': 3,
                     'etwas weniger als die hälfte der zeit': 2,
                     'ab und zu': 1,
                     'nie': 0},
 'DEPRESSION_CODES': {'0': 0,
                      '1': 1,
                      '2': 2,
                      '3': 3,
                      'gar nicht': 0,
                      'überhaupt nicht': 0,
                      'ueberhaupt nicht': 0,
                      'trifft nicht zu': 0,
                      'nie': 0,
                      'leicht': 1,
                      'ein wenig': 1,
                      'ein bisschen': 1,
                      'manchmal': 1,
                      'mäßig': 2,
                      'maessig': 2,
                      'ziemlich': 2,
                      'oft': 2,
                      'stark': 3,
                      'sehr stark': 3,
                      'fast immer': 3,
                      'immer': 3}}


@pytest.mark.parametrize("name", CODE_TABLES)
def test_code_tables(name):
    assert dict(getattr(text, name)) == CODE_TABLES[name]


@pytest.mark.parametrize("dof", [10.0**k for k in range(0, 15)])
def test_tails_at_any_degrees_of_freedom(dof):
    # F with two numerator degrees of freedom has a closed form.
    for f in (0.5, 3.0, 20.0):
        exact = math.exp(-dof / 2 * math.log1p(2 * f / dof))
        assert float(tails.inc_beta(dof / 2, 1, dof / (dof + 2 * f), 2 * f / (dof + 2 * f))) == pytest.approx(exact, rel=1e-10)
    # The 97.5 % point and its tail belong together.
    assert float(tails.t_tail(tails.t_quantile(0.975, dof), dof)) == pytest.approx(0.05, rel=1e-12)
    if dof >= 1e6:
        z = 1.959963984540054
        assert float(tails.t_quantile(0.975, dof)) == pytest.approx(z + (z**3 + z) / 4 / dof + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / dof**2, rel=1e-10)


def test_tail_of_one_and_two_degrees_of_freedom():
    for t in (0.1, 1.0, 7.0, 300.0):
        assert float(tails.t_tail(t, 1)) == pytest.approx(2 / math.pi * math.atan(1 / t), rel=1e-10)
        assert float(tails.t_tail(t, 2)) == pytest.approx(2 / (2 + t * t) / (1 + t / math.sqrt(2 + t * t)), rel=1e-10)


def test_tails_of_a_whole_batch():
    rng = np.random.default_rng(3)
    dof, t = rng.integers(1, 400, 200_000).astype(float), rng.uniform(0, 6, 200_000)
    start = time.perf_counter()
    got = tails.t_tail(t, dof)
    assert time.perf_counter() - start < 20
    # One by one the values are the same.
    assert got[:50] == pytest.approx([float(tails.t_tail(a, b)) for a, b in zip(t[:50], dof[:50])], rel=1e-13)
    quantiles = tails.t_quantile(0.975, dof)
    assert tails.t_tail(quantiles, dof) == pytest.approx(0.05, rel=1e-11)
    assert quantiles[dof == 1][0] == pytest.approx(math.tan(0.475 * math.pi), rel=1e-12)


def test_error_function_of_a_batch():
    z = np.concatenate([[0.0], np.geomspace(1e-8, 26, 500)])
    assert tails.erfc(z) == pytest.approx([math.erfc(v) for v in z], rel=1e-12)
    assert tails.erfc(40.0) == 0 and tails.erfc([]).shape == (0,)


def test_empty_and_unknown_batches():
    assert tails.inc_beta([], [], []).shape == (0,) and tails.t_quantile(0.975, []).shape == (0,)
    assert np.isnan(tails.inc_beta([2, np.nan], [3, 1], [0.5, 0.5])).tolist() == [False, True]
    assert tails.inc_beta(2, 3, [0.0, 1.0]).tolist() == [0.0, 1.0]
