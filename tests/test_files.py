"""Encodings by split, spoilt lines, and many files in one plan."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankwatch.operators import jobs
from tankwatch.params import Detection
from tankwatch.sources import ingest


def test_one_bad_byte_in_the_last_split(spark, tmp_path):
    lines = b"name,value\n" + b"".join(b"caf\xc3\xa9 %d,%d\n" % (k, k) for k in range(20_000))
    for name, data in (("good", lines), ("bad", lines + b"caf\xe9,1\n"), ("latin", lines.decode().encode("latin-1")), ("empty", b"")):
        (tmp_path / f"{name}.csv").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        got = {r.file.rsplit("/", 1)[-1]: (r.header, r.utf8) for r in ingest.manifest(spark, [f"file://{tmp_path}"]).collect()}
        assert got == {"good.csv": ("name,value", True), "bad.csv": ("name,value", False), "latin.csv": ("name,value", False)}
        rows = ingest.read_any_encoding(spark, [f"file://{tmp_path}/{n}.csv" for n in ("good", "latin")])
        assert rows.count() == 40_000 and rows.where(F.col("name").startswith("café ")).count() == 40_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_spoilt_lines_go_to_quarantine_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,2\n3\n3\n4,5,6\n"7,8\n9,"10"\n')
    (tmp_path / "b.csv").write_text("x,y\n1,2\n3\n")
    schema = T.StructType([T.StructField("x", T.IntegerType()), T.StructField("y", T.StringType())])
    good, bad = ingest.read_tolerant(spark, f"file://{tmp_path}", schema)
    assert sorted(map(tuple, good.collect())) == [(1, "2"), (1, "2"), (9, "10")]
    assert sorted((r.file[-5:], r.line, r.n) for r in bad.collect()) == [("a.csv", '"7,8', 1), ("a.csv", "3", 2), ("a.csv", "4,5,6", 1), ("b.csv", "3", 1)]


def test_a_plan_does_not_grow_with_the_files(spark, tmp_path):
    """The same size of plan for 3 and for 300 files; those that fail have an error each."""
    for k in range(300):
        (tmp_path / f"v{k}.csv").write_text(f"Vehiculo,Tiempo,Velocidad,Ignicion,Tanque Total,Coordenadas\n{k % 7},01.01.2024 00:{k % 60:02d}:00,0 km/h,apagado,{k}.5,\"4.0, -74.0\"\n" if k % 50 else "ref\n1\n")

    class Echo:
        """Rows as events, so that the test needs no model."""

        def spread(self, who):
            return self

        def score(self, rows, p):
            Echo.plan = rows._jdf.queryExecution().optimizedPlan().toString()
            return rows.select("vehicle_id", F.col("timestamp").alias("start_time"), F.col("total_fuel_gal").alias("score"))

    plans = []
    for n in (3, 300):
        paths = [f"file://{tmp_path}/v{k}.csv" for k in range(1, n + 1)] + [f"file://{tmp_path}/absent.csv"]
        events, failed = jobs.score_files(spark, paths, Echo(), Detection())
        plans.append(Echo.plan.count("\n"))
        got = {r.source: (r.vehicle_id, r.score) for r in events.collect()}
        assert got == {f"v{k}.csv": (str(k % 7), k + 0.5) for k in range(1, min(n, 299) + 1) if k % 50}
        errors = {r.source: r.error for r in failed.collect()}
        assert errors == {"absent.csv": "not found", **({"v300.csv": "not found"} if n == 300 else {}), **{f"v{k}.csv": "no timestamp column" for k in range(50, min(n, 299) + 1, 50)}}
    assert plans[0] == plans[1]
    with pytest.raises(ValueError):
        ingest.load_many(spark, [f"file://{tmp_path}/absent.csv", f"file://{tmp_path}/v50.csv"])


def test_a_stored_table_has_few_files_however_many_vehicles(spark, tmp_path):
    path = tmp_path / "combined"
    rows = spark.range(0, 8000, 1, 4).select("id", F.concat(F.lit("0"), F.col("id") % 2000).alias("vehicle_id"))
    ingest.save_table(rows, f"file://{path}")
    assert len(list(path.glob("**/*.parquet"))) <= 2 * ingest.FOLDERS
    back = ingest.load_table(spark, f"file://{path}")
    assert back.columns == ["id", "vehicle_id"] and dict(back.dtypes)["vehicle_id"] == "string"
    assert back.exceptAll(rows).isEmpty() and back.count() == 8000
    files = back.select("vehicle_id", F.input_file_name().alias("f")).where("vehicle_id = '07'").distinct()
    assert files.count() == 1
