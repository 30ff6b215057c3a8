import json

import pytest
from conftest import d, rows
from pyspark.sql import functions as F

from panelspark.operators import regions as rg
from panelspark.sources import files, schemas


def test_delimited_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("FIPS;RUCC_2013;extra\n01001;2;x\n1003;;y\n")
    got = files.read_delimited(spark, str(tmp_path / "a.csv"), schemas.RURAL_URBAN, sep=";", columns=["FIPS", "RUCC_2013"])
    assert rows(got, "FIPS", "RUCC_2013") == [(1001, 2), (1003, None)]
    (tmp_path / "b.csv").write_text("Date,FIPS,Series_Complete_Pop_Pct,Series_Complete_Yes,other\n02/03/2021,UNK,1.5,7,x\n02/03/2021,48001,50,8,x\n11/01/2021,48001,60,9,x\n02/03/2021,1001,NaN,3,x\n")
    raw = files.read_delimited(spark, str(tmp_path / "b.csv"), schemas.VACCINATIONS, columns=["Date", "FIPS", "Series_Complete_Pop_Pct", "Series_Complete_Yes"])
    v = rg.vaccination_table(raw, blank_state=48, blank_before="2021-10-22")
    assert rows(v, "region", F.date_format("date", "yyyy-MM-dd"), "fraction_vaccinated", "cumulative_vaccinations", "state") == [
        (1001, "2021-02-03", None, 3, 1), (48001, "2021-02-03", None, None, 48), (48001, "2021-11-01", 0.6, 9, 48)]
    assert rg.vaccination_table(raw, drop_state=48).count() == 1
    (tmp_path / "c.tsv").write_text("user_loc\tfr_loc\tscaled_sci\n1\t2\t3.5\n")
    assert tuple(files.read_delimited(spark, str(tmp_path / "c.tsv"), schemas.INDEX, sep="\t").first()) == (1, 2, 3.5)
    text = files.read_delimited(spark, str(tmp_path / "a.csv"), sep=";", columns=["FIPS"])
    assert rows(text, "FIPS") == [("01001",), ("1003",)]


def test_population_and_gini(spark):
    raw = spark.createDataFrame([("01", "001", "55869"), ("02", "013", "3337")], schemas.POPULATION)
    assert rows(rg.population_table(raw, [(2261, 9243)]), "region", "population") == [(1001, 55869), (2013, 3337), (2261, 9243)]
    g = spark.createDataFrame([("id", "Estimate!!Gini"), ("0500000US01001", "0.45")], schemas.GINI)
    assert rows(rg.gini_table(g), "region", "gini") == [(1001, 0.45)]


def test_wide_days(spark, tmp_path):
    (tmp_path / "w.csv").write_text("countyFIPS,County Name,State,StateFIPS,2021-01-01,2021-01-02\n0,Unallocated,AL,1,0,0\n1001,Autauga,AL,1,5,6\n")
    wide = files.read_wide_days(spark, str(tmp_path / "w.csv"))
    long = rg.wide_to_long(wide, wide.columns[:4], "cases", keep={"countyFIPS": "region"})
    assert rows(long.where("region > 0"), "region", "date", "cases") == [(1001, d(0), 5), (1001, d(1), 6)]


def test_json_lines_and_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a \"quoted\" text", "accept"), ("b", "ignore")], schemas.ANSWERS)
    files.write_json_lines(df, str(tmp_path / "j"))
    assert {json.loads(x)["answer"] for p in (tmp_path / "j").glob("*.json") for x in p.read_text().splitlines()} == {"accept", "ignore"}
    both = files.read_json_lines(spark, [str(tmp_path / "j"), str(tmp_path / "j")], schemas.ANSWERS)
    assert both.count() == 4
    files.write_csv(df, str(tmp_path / "c"))
    assert rows(files.read_delimited(spark, str(tmp_path / "c"), schemas.ANSWERS), "answer") == [("accept",), ("ignore",)]


def test_write_by_date_replaces_only_its_dates(spark, tmp_path):
    path = str(tmp_path / "p")
    files.write_by_date(spark.createDataFrame([(d(0), 1), (d(1), 2)], "date date, x int"), path)
    files.write_by_date(spark.createDataFrame([(d(1), 3)], "date date, x int"), path)
    assert rows(spark.read.parquet(path), "date", "x") == [(d(0), 1), (d(1), 3)]


def test_log_transforms(spark):
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 3.0, 50.0), (3, 8.0, 100.0)], "region int, x double, pct double")
    got = rg.log_transforms(df, ["x", "absent"], ["pct"])
    import math

    assert got.columns == ["region", "x_log", "pct_neglog"]
    assert rows(got, *got.columns) == [(1, pytest.approx(math.log2(1.03)), 0.0), (2, pytest.approx(math.log2(3.03)), pytest.approx(1.0)), (3, pytest.approx(math.log2(8.03)), None)]


def test_assemble_panel(spark):
    base = spark.createDataFrame([(r, d(t), r // 1000, 10 + t) for r in (1001, 2001, 72001) for t in range(3) if not (r == 2001 and t == 1)], "region int, date date, state int, vax int")
    act = spark.createDataFrame([(1001, d(1), 4, 2), (3001, d(1), 9, 9)], "region int, date date, n_events long, n_flagged long")
    deaths = spark.createDataFrame([(1001, d(0), 1), (1001, d(2), 3)], "region int, date date, deaths int")
    cases = spark.createDataFrame([(1001, d(0), 5)], "region int, date date, cases int")
    pops = spark.createDataFrame([(1001, 8), (2001, 5), (3001, 7), (72001, 9)], "region int, population int")
    out = rg.assemble_panel(base, act, deaths, cases, pops, "2021-01-01", "2022-01-01", {"n_flagged": "cum_flagged", "n_events": "cum_events"})
    # 3001 has no state, 72001 is no state of the union, 2001 lacks a day
    assert rows(out, "region", "date", "vax", "deaths", "cases", "cum_events", "cum_flagged", "n_events_all_time_per_capita_log") == [
        (1001, d(0), 10, 1, 5, 0, 0, -1.0), (1001, d(1), 11, None, None, 4, 2, -1.0), (1001, d(2), 12, 3, None, 4, 2, -1.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan


def test_rate_map_and_coverage(spark):
    p = spark.createDataFrame([(1001, d(0), 1, 10), (1001, d(1), 4, 10), (20001, d(1), 0, 10)], "region int, date date, m int, population int")
    got = rows(rg.rate_map(p, "m"), "code", "rate", "rate_log")
    assert got[0][:2] == ("01001", 0.2) and got[1] == ("20001", 0.0, None)
    assert rows(rg.rate_map(p, "m", per_last_row=True), "code", "rate")[0] == ("01001", 0.4)
    assert rows(rg.coverage({"a": p, "b": p.where("region > 2000")}), "source", "code") == [("a", "01001"), ("a", "20001"), ("b", "20001")]
