import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterlab.functions.calendar import season_of, temporada_of
from meterlab.operators import activity, preparation as prep
from meterlab.plans.cleaning import clean_readings

START = dt.datetime(2012, 5, 1)


def half_hours(n, start=START):
    return [start + dt.timedelta(minutes=30 * i) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "lc_lid string, tstp timestamp_ntz, energy_kwh_hh double")


def test_removal_is_strict(spark):
    # 100 slots each: none missing, exactly 10 %, 12 %.  Ends are kept so the span stays.
    rows = []
    for key, gone in (("full", 0), ("limit", 10), ("over", 12)):
        rows += [(key, ts, float(i % 7)) for i, ts in enumerate(half_hours(100)) if not 20 <= i < 20 + gone]
    filled = prep.gap_fill(frame(spark, rows), "lc_lid", "tstp", "30 MINUTES")
    rates = {r[0]: r[1] for r in prep.null_rate(filled, "lc_lid", "energy_kwh_hh").collect()}
    assert rates == {"full": 0.0, "limit": 0.1, "over": 0.12}
    kept = prep.drop_sparse(filled, "lc_lid", "energy_kwh_hh").select("lc_lid").distinct().collect()
    assert {r[0] for r in kept} == {"full", "limit"}


def test_gap_fill_is_idempotent_and_complete(spark):
    rows = [("a", ts, 1.0) for i, ts in enumerate(half_hours(50)) if i % 7]
    once = prep.gap_fill(frame(spark, rows), "lc_lid", "tstp", "30 MINUTES")
    twice = prep.gap_fill(once, "lc_lid", "tstp", "30 MINUTES")
    assert once.count() == twice.count() == 48  # both ends fall out
    assert prep.missing_slots(once, "lc_lid", "tstp", "30 MINUTES").count() == 0


def test_missing_summary_has_array_and_count(spark):
    rows = [("a", ts, 1.0) for i, ts in enumerate(half_hours(6)) if i not in (2, 3)] + [("b", START, 1.0)]
    got = {r["lc_lid"]: r for r in prep.missing_slot_summary(frame(spark, rows), "lc_lid", "tstp", "30 MINUTES").collect()}
    assert got["a"]["missing"] == [half_hours(4)[2], half_hours(4)[3]] and got["a"]["n_missing"] == 2
    assert got["b"]["missing"] == [] and got["b"]["n_missing"] == 0


def test_fallback_is_mean_after_hourly_fill(spark):
    # Hour 0: values 1 and 3, hour 1: value 8 and a gap, hour 2: only gaps.
    t = half_hours(6)
    rows = [("a", t[0], 1.0), ("a", t[1], 3.0), ("a", t[2], 8.0), ("a", t[3], None), ("a", t[4], None), ("a", t[5], None)]
    got = {r[1]: r[2] for r in prep.impute_hour_mean(frame(spark, rows), "lc_lid", "tstp", "energy_kwh_hh").collect()}
    assert got[t[3]] == 8.0
    assert got[t[4]] == got[t[5]] == pytest.approx((1 + 3 + 8 + 8) / 4)


@pytest.mark.parametrize("day,slots", [("2012-03-25", 7), ("2012-10-28", 11)])
def test_clock_change_days(spark, day, slots):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        df = spark.sql(f"SELECT 'a' AS k, TIMESTAMP '{day} 00:00:00' AS t UNION ALL SELECT 'a', TIMESTAMP '{day} 04:00:00'")
        assert prep.slot_calendar(df, "k", "t", "30 MINUTES").count() == slots
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_daily_exempt_list(spark):
    days = prep.daily_exempt_slots(spark, "2012-03-25 01:00:00", "2012-03-31 01:00:00")
    assert days.count() == 7


def test_seasons(spark):
    df = spark.sql("SELECT explode(sequence(DATE '2023-01-15', DATE '2023-12-15', INTERVAL 1 MONTH)) AS d")
    got = [tuple(r) for r in df.select(season_of(F.col("d")), temporada_of(season_of(F.col("d")))).collect()]
    names = ["Winter"] * 2 + ["Spring"] * 3 + ["Summer"] * 3 + ["Autumn"] * 3 + ["Winter"]
    assert got == [(n, "warm" if n == "Summer" else "cold") for n in names]


def test_constant_and_single_rows_give_null(spark):
    rows = [("flat", ts, 2.0) for ts in half_hours(4)] + [("one", START, 5.0)]
    z = activity.zscore(frame(spark, rows), "energy_kwh_hh", ["lc_lid"], "z").select("z").distinct().collect()
    assert [r[0] for r in z] == [None]


def test_block_across_season_boundary_splits(spark):
    start = dt.datetime(2012, 5, 31, 20)
    rows = [("a", start + dt.timedelta(hours=i), float(i * i % 5)) for i in range(14)]
    blocks = activity.block_variance(frame(spark, rows), "lc_lid", "tstp", "energy_kwh_hh").collect()
    first = [r for r in blocks if r["window_start"] == start]
    assert {r["season"] for r in first} == {"Spring", "Summer"} and len(blocks) == 4


def test_single_row_block_counts_as_zero_variance(spark):
    # Two full blocks with variance and one trailing single-row block.
    rows = [("a", START + dt.timedelta(hours=i), float((i * 7) % 5)) for i in range(13)]
    home = activity.detect_home(frame(spark, rows), "lc_lid", "tstp", "energy_kwh_hh", keep_block=True)
    last = home.orderBy(F.desc("tstp")).first()
    assert last["is_home"] is False


def test_winsorise_keeps_rows_and_caps(spark):
    rows = [("a", ts, float(i)) for i, ts in enumerate(half_hours(40))] + [("a", START, 1e6)]
    out = prep.winsorise(frame(spark, rows), "energy_kwh_hh", ["lc_lid"])
    assert out.count() == 41 and out.agg(F.max("energy_kwh_hh")).first()[0] < 41


def test_clean_readings_partitions_ids(spark):
    rows = []
    for key, gone in (("ok", 0), ("bad", 30)):
        rows += [(key, ts, float((i * 13) % 11)) for i, ts in enumerate(half_hours(96)) if not 10 <= i < 10 + gone]
    rows += [("spiky", ts, 100.0 if i % 12 < 2 else float(i % 3)) for i, ts in enumerate(half_hours(96))]
    rows += rows[:50]  # exact copies
    out = clean_readings(frame(spark, rows))
    removed = {r["id_removed"]: r["motive"] for r in out.removed.collect()}
    assert removed == {"bad": "NA excess", "spiky": "Outlier Excess"}
    assert {r[0] for r in out.hourly.select("lc_lid").distinct().collect()} == {"ok"}
    assert out.hourly.count() == 48


def test_minmax_and_constant(spark):
    df = spark.createDataFrame([(1.0, 4.0), (3.0, 4.0), (2.0, 4.0)], "a double, b double")
    assert sorted(r[0] for r in prep.minmax(df, "a").select("a").collect()) == [0.0, 0.5, 1.0]
    assert {r[0] for r in prep.minmax(df, "b").select("b").collect()} == {None}


def test_gaps_between_neighbours(spark):
    """Rows on and between slots, shared slots and clock changes give the slots a calendar would."""
    import random

    from meterlab.operators.preparation import collapse_slots, gap_slots, mark_gaps, missing_slots

    rng = random.Random(2)
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        rows = []
        for k in range(8):
            start = 1332547200 + 1800 * rng.randint(0, 9)  # around 25 March 2012
            for i in sorted(rng.sample(range(200), 60)):
                for _ in range(1 + (rng.random() < 0.1)):
                    rows.append((f"h{k}", start + 1800 * i + (7 if rng.random() < 0.1 else 0), rng.random()))
        rows.append(("single", 1332547200, 1.0))
        df = spark.createDataFrame(rows, "id string, at bigint, x double").selectExpr("id", "timestamp_seconds(at) AS ts", "x")
        for table, step in ((df, "30 minutes"), (df.selectExpr("id", "cast(ts as timestamp_ntz) AS ts", "x"), "30 minutes"), (df, "1 hour")):
            cells = collapse_slots(mark_gaps(table, "id", "ts", step), "id", "ts", "x", "hour")
            got = gap_slots(cells, "id", "ts", step)
            want = missing_slots(table, "id", "ts", step)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
            exempt = want.select("ts").distinct().limit(20)
            assert gap_slots(cells, "id", "ts", step, exempt).exceptAll(missing_slots(table, "id", "ts", step, exempt)).isEmpty()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_cleaning_equals_the_slot_by_slot_chain(spark):
    import random

    from meterlab.operators import preparation as prep
    from meterlab.plans.cleaning import clean_readings

    rng = random.Random(6)
    rows = [(f"h{k}", 1700000000 // 1800 * 1800 + 1800 * i, round(rng.random(), 3), f"b{k % 2}") for k in range(6) for i in range(500) if rng.random() > 0.03 * k]
    df = spark.createDataFrame(rows, "id string, at bigint, x double, file string").selectExpr("id", "cast(timestamp_seconds(at) as timestamp_ntz) AS ts", "x", "file")
    got = clean_readings(df, "id", "ts", "x", block="file")
    filled = prep.gap_fill(prep.distinct_complete(df.select("id", "ts", "x")), "id", "ts", "30 minutes")
    want = prep.downsample(prep.impute_hour_mean(prep.drop_sparse(filled, "id", "x"), "id", "ts", "x"), "id", "ts", "x")
    a, b = (sorted((r.id, r.ts, round(r.x, 9)) for r in t.collect()) for t in (got.hourly, want))
    assert a == b and len({r[0] for r in a}) == 4
    assert sorted(map(tuple, got.removed.collect())) == [("h4", "b0", "NA excess"), ("h5", "b1", "NA excess")]
