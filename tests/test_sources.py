import datetime as dt

from meterlab.sources import readers, writers

RAW = "LCLid,tstp,energy(kWh/hh)\n"


def test_read_block_files(spark, tmp_path):
    (tmp_path / "block_0.csv").write_text(RAW + "MAC1,2012-06-01 00:00:00.0000000,0.25\nMAC1,2012-06-01 00:30:00.0000000,Null\n")
    (tmp_path / "block_1.csv").write_text(RAW + "MAC2,2012-06-01 00:00:00.0000000, 0.5 \n")
    df = readers.read_readings(spark, str(tmp_path))
    assert df.columns == ["lc_lid", "tstp", "energy_kwh_hh", "file"]
    got = sorted(tuple(r) for r in df.collect() if r["energy_kwh_hh"] is not None)
    at = dt.datetime(2012, 6, 1)
    assert got == [("MAC1", at, .25, "block_0"), ("MAC2", at, .5, "block_1")]
    assert df.where("energy_kwh_hh is null").count() == 1


def test_names():
    names = {"energy(kWh/hh)": "energy_k_wh_hh", "temperature_2m (°C)": "temperature_2m_c",
             "relative_humidity_2m (%)": "relative_humidity_2m_percent", "pressure_msl (hPa)": "pressure_msl_h_pa",
             "weather_code (wmo code)": "weather_code_wmo_code", "Acorn_grouped": "acorn_grouped",
             "vapour_pressure_deficit (kPa)": "vapour_pressure_deficit_k_pa", "wind_speed_10m (km/h)": "wind_speed_10m_km_h"}
    assert {n: readers.snake_case(n) for n in names} == names


def test_weather_load(spark, tmp_path):
    (tmp_path / "w.csv").write_text(
        "time,temperature_2m (°C),weather_code (wmo code),wind_direction_100m (°)\n"
        "2012-06-01T00:00,11.5,3,9\n2012-06-01T01:00,,3,9\n")
    schema = "time string, `temperature_2m (°C)` double, `weather_code (wmo code)` int, `wind_direction_100m (°)` double"
    df = readers.read_weather(spark, str(tmp_path / "w.csv"), schema)
    assert df.columns == ["time", "temperature_2m_c", "weather_code_wmo_code"]
    assert dict(df.dtypes)["time"] == "timestamp" and dict(df.dtypes)["weather_code_wmo_code"] == "string"
    assert readers.incomplete_rows(df).count() == 1


def test_local_time(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        df = spark.createDataFrame([("2012-07-01 12:00:00",), ("nonsense",)], "s string")
        got = [r[0] for r in df.select(readers.to_local_ts("s").cast("long")).collect()]
        assert got == [int(dt.datetime(2012, 7, 1, 11, tzinfo=dt.timezone.utc).timestamp()), None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_block_output_round_trip(spark, tmp_path):
    df = spark.range(300).selectExpr("id", "concat('block_', id % 3) AS file")
    writers.write_hourly(df, str(tmp_path / "h"), files_per_block=2)
    assert sorted(p.name for p in (tmp_path / "h").iterdir() if p.is_dir()) == ["file=block_0", "file=block_1", "file=block_2"]
    back = readers.read_stage(spark, str(tmp_path / "h"))
    assert sorted(map(tuple, back.select("id", "file").collect())) == sorted(map(tuple, df.collect()))
    writers.write_by_block(df, str(tmp_path / "c"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 300


def test_audit_and_stage_tables(spark, tmp_path):
    audit = spark.createDataFrame([("a", "block_0", "NA excess"), ("b", "block_1", "Outlier Excess")], "id_removed string, block string, motive string")
    writers.write_removed_ids(audit, str(tmp_path / "r"))
    assert sorted(map(tuple, readers.read_stage(spark, str(tmp_path / "r")).select(*audit.columns).collect())) == sorted(map(tuple, audit.collect()))
    writers.write_households(audit, str(tmp_path / "t"))
    writers.write_stationary(audit.withColumnRenamed("block", "file"), str(tmp_path / "s"))
    assert readers.read_stage(spark, str(tmp_path / "s")).count() == readers.read_stage(spark, str(tmp_path / "t")).count() == 2


def test_households(spark, tmp_path):
    (tmp_path / "hh.csv").write_text("LCLid,stdorToU,Acorn,Acorn_grouped,file\nMAC1,Std,ACORN-A,Affluent,block_0\n")
    assert readers.read_households(spark, str(tmp_path / "hh.csv")).first()["Acorn_grouped"] == "Affluent"


def test_blocks_are_pruned_and_rewritten_alone(spark, tmp_path):
    from pyspark.sql import functions as F

    from meterlab.sources.readers import read_stage
    from meterlab.sources.writers import write_by_block

    path = str(tmp_path / "blocks")
    df = spark.range(1000).select("id", F.concat(F.lit("b"), F.col("id") % 4).alias("file"))
    write_by_block(df, path)
    one = read_stage(spark, path).where("file = 'b2'")
    assert one.count() == 250
    assert "PartitionFilters: [isnotnull(file" in one._jdf.queryExecution().executedPlan().toString()
    write_by_block(df.where("file = 'b2' and id < 100"), path, overwrite="dynamic")
    assert read_stage(spark, path).groupBy("file").count().orderBy("file").collect() == [("b0", 250), ("b1", 250), ("b2", 25), ("b3", 250)]
