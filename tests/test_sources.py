import random

import pytest
from pyspark.sql import types as T

from duowave.checks.rows import _two_headers
from duowave.operators.visits import when_fallback
from duowave.sources import exports, records

TEXT = '''Patient ID,Größe (cm),Aktiv,Bemerkung,Größe (cm)
 a ,170,TRUE,"erste
Zeile, ""zweite""",1
b,NULL,false,NA,2
c,1d,,NaN,
a,"1,5",F,x,4
'''


@pytest.fixture
def export(tmp_path):
    path = tmp_path / "export.csv"
    path.write_text(TEXT, encoding="utf-8")
    return str(path)


def test_reading_an_export(spark, export):
    types = {"grosse_cm": T.DoubleType(), "aktiv": T.BooleanType()}
    df = exports.read_export(spark, export, types)
    assert df.columns == ["patient_id", "grosse_cm", "aktiv", "bemerkung", "grosse_cm_2", "ingest_seq"]
    got = [tuple(r)[:5] for r in df.orderBy("ingest_seq").collect()]
    assert got == [("a", 170.0, True, 'erste\nZeile, "zweite"', 1), ("b", None, False, None, 2),
                   ("c", None, None, None, None), ("a", None, False, "x", 4)]
    plain = exports.read_export(spark, export, infer=False)
    assert {kind for c, kind in plain.dtypes if c != "ingest_seq"} == {"string"}


def test_inferred_types(spark, tmp_path):
    path = tmp_path / "typed.csv"
    path.write_text("id,n,x,flag,at,zip,empty,day\n1,5,1.5,TRUE,2025-10-13T09:54:00+02:00,01067,,45000.5\n"
                    "2,,2,f,2025-10-13T09:54:00Z,12345,NA,45001\n900719925474099312,7,,,,,,\n", encoding="utf-8")
    df = exports.read_export(spark, str(path), ingest_seq=False)
    assert dict(df.dtypes) == {"id": "bigint", "n": "bigint", "x": "double", "flag": "boolean", "at": "timestamp_ntz",
                               "zip": "string", "empty": "string", "day": "double"}
    assert [str(r["at"]) for r in df.orderBy("id").collect()] == ["2025-10-13 07:54:00", "2025-10-13 09:54:00", "None"]
    assert df.agg({"id": "max"}).first()[0] == 900719925474099312


def test_files_with_other_headers(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('patient,x,y\np,1,2\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text('\ufeffpatient,y,x\nq,3,4\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text('"patient","z\nz"\nr,"5"\n', encoding="utf-8")
    df = exports.read_export(spark, str(tmp_path), ingest_seq=False)
    assert sorted(map(tuple, df.select("patient", "x", "y", "z_z").collect()), key=repr) == [
        ("p", 1, 2, None), ("q", 4, 3, None), ("r", None, None, 5)]


def test_headers_are_read_without_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "HEADERS_AT_ONCE", 4)
    (tmp_path / "long.csv").write_text("id,x\n" + "12345678,some text\n" * 2_000_000, encoding="utf-8")
    for i in range(5):
        (tmp_path / f"short{i}.csv").write_text(f"id,x{i}\n1,2\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    files = spark._jvm.org.apache.hadoop.fs.FileSystem
    files.clearStatistics()
    got = {name.rsplit("/", 1)[1]: line for name, line in exports._first_lines(spark, str(tmp_path))}
    read = sum(s.getBytesRead() for s in files.getAllStatistics())
    assert got == {"long.csv": "id,x", **{f"short{i}.csv": f"id,x{i}" for i in range(5)}}
    # Of 38 MB.
    assert 0 < read < 2_000_000


def test_file_names_with_pattern_signs(spark, tmp_path):
    (tmp_path / "a[1].csv").write_text("id,x\n1,2\n", encoding="utf-8")
    (tmp_path / "a{2,3}*.csv").write_text("id,y\n3,4\n", encoding="utf-8")
    df = exports.read_export(spark, str(tmp_path), ingest_seq=False)
    assert sorted(map(tuple, df.select("id", "x", "y").collect())) == [(1, 2, None), (3, None, 4)]


def test_halves_with_other_headers_are_written_in_parallel(spark):
    class Views(dict):
        pass

    views = Views(fx_demographics=spark.range(1, 401, numPartitions=4).withColumnRenamed("id", "patient"))
    views.spark = spark
    files = exports.read_export(spark, _two_headers(views)).groupBy("ingest_seq.file").count().collect()
    assert len(files) == 8 and sum(r["count"] for r in files) == 400


def test_file_order_numbers_visits(spark, export):
    df = when_fallback(exports.read_export(spark, export), ["patient_id"], "ingest_seq")
    assert [(r.patient_id, r.when_dt.second) for r in df.orderBy("ingest_seq").collect()] == [
        ("a", 1), ("b", 1), ("c", 1), ("a", 2)]


def test_unknown_typed_column(spark, export):
    with pytest.raises(ValueError):
        exports.read_export(spark, export, {"nope": T.DoubleType()})


def test_results_are_checked_when_read_back(spark, tmp_path):
    path = str(tmp_path / "result")
    exports.write_csv(spark.createDataFrame([("age", 0.5, None)], "term string, estimate double, p_value double"), path)
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("p_value", T.DoubleType()),
                           T.StructField("estimate", T.DoubleType())])
    assert tuple(exports.read_result_checked(spark, path, schema).first()) == ("age", 0.5, None)
    with pytest.raises(ValueError):
        exports.read_result_checked(spark, path, schema, ["conf_low"])


def write_quoted(folder, n_rows, long_lines):
    """Two files with line ends, quotes and commas within cells; one cell is longer than several splits."""
    rng = random.Random(5)
    bits = ["x", " ", ",", '""', "\n", "ä", "\n\n", "1"]

    def cell():
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        return f'"{text}"' if rng.random() < 0.7 else "plain"

    for name, n in (("one.csv", n_rows), ("two.csv", 3)):
        rows = [f"{i},{cell()},{cell()}" for i in range(n)]
        if n > 3:
            rows[n // 2] = f'{n // 2},"' + "long\nline " * long_lines + '",end'
            rows.insert(n // 4, "")
        (folder / name).write_text('id,"te\nxt",b\n' + "\n".join(rows) + "\n", encoding="utf-8")
    return str(folder)


# Intermediate tables are read in splits of the same size, so the smallest splits have fewer rows.
@pytest.mark.parametrize("split_bytes, n_rows, long_lines", [(64, 12, 20), (700, 300, 500), (5000, 300, 500)])
def test_quoted_files_are_split(spark, tmp_path, split_bytes, n_rows, long_lines):
    quoted = write_quoted(tmp_path, n_rows, long_lines)
    whole = exports.read_export(spark, quoted, infer=False, split_above=10**9)
    want = sorted(map(tuple, whole.drop("ingest_seq").collect()), key=repr)
    assert len(want) == n_rows + 3
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = exports.read_export(spark, quoted, infer=False, split_above=0)
        assert sorted(map(tuple, df.drop("ingest_seq").collect()), key=repr) == want
        first = df.where("ingest_seq.file like '%one.csv'").orderBy("ingest_seq")
        assert [int(r["id"]) for r in first.collect()] == list(range(n_rows))
        assert df.select("ingest_seq.block").distinct().count() > ({64: 5, 700: 10, 5000: 1}[split_bytes])
        monkey = pytest.MonkeyPatch()
        monkey.setattr(records, "broadcast_if_small", lambda table: table)
        assert sorted(map(tuple, exports.read_export(spark, quoted, infer=False, split_above=0).drop("ingest_seq").collect()), key=repr) == want
        monkey.undo()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_are_cut_by_quotes():
    lines = [("f", 0, 0, 'a,"b'), ("f", 0, 0, 'c",d'), ("f", 0, 0, 'e,"'), ("f", 9, 1, "in"), ("f", 12, 1, 'x",y'), ("f", 12, 1, "z"), ("g", 0, 0, '"q')]
    assert list(records._cut(iter(lines))) == [
        ("f", 0, 0, records.WHOLE, 'a,"b\nc",d'), ("f", 0, 2, records.START, 'e,"'), ("f", 9, 0, records.END, "in"),
        ("f", 12, 0, records.END, 'x",y'), ("f", 12, 1, records.WHOLE, "z"), ("g", 0, 0, records.START, '"q')]
