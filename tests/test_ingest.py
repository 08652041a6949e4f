from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from techfolio.functions import cleaning as cl
from techfolio.operators import ingest
from techfolio.sources import award_csv, schemas, tables

AT = dt.datetime(2025, 1, 15)


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def write(tmp_path, text):
    (tmp_path / "awards.csv").write_text(text)
    return str(tmp_path / "awards.csv")


def test_aliases_and_values(spark, tmp_path):
    path = write(tmp_path, "award_id,agency_code,abstract,amount,firm,state\nABC-001,DOD,\"Research, with\nbreak\",100000,TechCorp,CA\n")
    r = ingest.clean_awards(award_csv.read_award_csv(spark, path), AT).first()
    assert (r.agency, r.award_amount, r.firm_name, r.firm_state, r.abstract) == ("DOD", 100000.0, "TechCorp", "CA", "Research, with\nbreak")
    assert (r.topic_code, r.phase, r.firm_city, r.award_date) == ("UNKNOWN", "Other", "Unknown", dt.date(2025, 1, 15))


def test_canonical_column_is_not_replaced():
    assert award_csv.column_aliases(["award_id", "agency", "agency_code", "amount", "dollars"]) == {"amount": "award_amount"}


def test_missing_columns_are_named(spark, tmp_path):
    with pytest.raises(ValueError, match="abstract, award_amount"):
        award_csv.read_award_csv(spark, write(tmp_path, "award_id,agency\n1,DOD\n"))


def test_bad_rows_are_quarantined(spark, tmp_path):
    text = "award_id,agency,abstract,award_amount\nABC-001,DOD,a,150000\n,DOD,b,250000\nABC-003,DOD,c,invalid_amount\nABC-004,DOD,d,75000\n"
    checked = ingest.validate(ingest.clean_awards(award_csv.read_award_csv(spark, write(tmp_path, text)), AT))
    r = ingest.load_report(checked).first()
    assert (r.total_rows, r.loaded_rows, r.skipped_rows) == (4, 2, 2)
    good, bad = ingest.split_valid(checked)
    assert sorted(x.award_id for x in good.collect()) == ["ABC-001", "ABC-004"]
    assert {x.rule: x.failures for x in ingest.failure_reasons(checked).collect()} == {"id_present": 1, "amount_positive": 1}
    assert bad.count() == 2


def test_phases(spark):
    values = ["I", "1", "ONE", "II", "2", "two", "III", "3", "THREE", "IV", "Unknown", "Phase II"]
    assert column(spark, values, cl.normalize_phase) == ["I"] * 3 + ["II"] * 3 + ["III"] * 3 + ["Other"] * 2 + ["II"]
    assert column(spark, ["Phase II"], lambda c: cl.normalize_phase(c, False)) == ["Other"]


def test_amounts(spark):
    values = ["150000", "$150000", "$150,000.00", "1,500,000.00", " $ 150,000 ", "x"]
    assert column(spark, values, cl.parse_amount) == [150000.0, 150000.0, 150000.0, 1500000.0, 150000.0, None]


def test_dates(spark):
    d = dt.date
    values = ["2023", "2023-06-15", "invalid", "06/15/2023", "June 5, 2023", "2023-06-15 10:00:00"]
    assert column(spark, values, cl.parse_date) == [d(2023, 7, 1), d(2023, 6, 15), None, d(2023, 6, 15), d(2023, 6, 5), d(2023, 6, 15)]


def test_agencies_and_states(spark):
    long = "An agency with a remarkably long name"
    assert column(spark, ["Department of Defense", "department of ENERGY", "NSF", long, ""], cl.normalize_agency) == ["DOD", "DOE", "NSF", "UNKNOWN", "UNKNOWN"]
    assert column(spark, ["California", "oh", "Atlantis", "new york"], cl.normalize_state) == ["CA", "OH", "XX", "NY"]


def test_text_or_keywords_needed(spark):
    rows = [("t", ["k"]), ("t", []), (None, ["k"]), (None, [])]
    df = spark.createDataFrame([(a, k, "1", "DOD", 1.0, dt.date(2023, 1, 1)) for a, k in rows],
                               "abstract string, keywords array<string>, award_id string, agency string, award_amount double, award_date date")
    checked = ingest.validate(df, ingest.prevalidation_rules())
    assert [r.failed_rules for r in checked.collect()] == [[], [], [], ["has_text"]]


def test_yearly_rows_keep_the_last(spark, tmp_path):
    head = ",".join(["award_id", "agency_code", "bureau_code", "topic_code", "abstract", "keywords", "phase", "firm", "firm_city", "firm_state", "award_amount", "award_year"])
    lines = ["AF123,AF,AFRL,AF-001,a,propulsion;hypersonic,I,Aero Labs,Dayton,OH,150000,2023-06-01",
             "AF123,AF,AFRL,AF-001,b,propulsion;hypersonic,I,Aero Labs,Dayton,OH,160000,2023-06-01",
             "NAV456,NAVY,ONR,NAV-010,c,communications;undersea,II,Blue Sea Tech,San Diego,CA,900000,2023-09-15"]
    write(tmp_path, "\n".join([head, *lines]) + "\n")
    raw = award_csv.read_yearly_csv(spark, str(tmp_path)).withColumn("n", F.monotonically_increasing_id())
    clean = ingest.clean_awards(raw, AT, kw_sep=";", year_only="01-01")
    kept = {r.award_id: r for r in ingest.dedup_last(clean, ["award_id", "agency"], [F.desc("n")]).collect()}
    assert set(kept) == {"AF123", "NAV456"} and kept["AF123"].award_amount == 160000.0
    assert kept["AF123"].keywords == ["propulsion", "hypersonic"]


def test_dynamic_partition_overwrite(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda rows: spark.createDataFrame(rows, "award_id string, fiscal_year int")
    tables.write_partitions(df([("a", 2022), ("b", 2023)]), path)
    tables.write_partitions(df([("c", 2023)]), path)
    assert sorted((r.award_id, r.fiscal_year) for r in spark.read.parquet(path).collect()) == [("a", 2022), ("c", 2023)]
    assert tables.read_partition(spark, path, 2022, ["award_id"]).first().award_id == "a"
    assert sorted(r[0] for r in tables.list_partitions(spark, path).collect()) == [2022, 2023]


def test_cache_upsert_and_purge(spark):
    df = lambda rows: spark.createDataFrame([(s, i, d, dt.datetime(2024, 1, n)) for s, i, d, n in rows], "api_source string, solicitation_id string, description string, retrieved_at timestamp_ntz")
    old = df([("grants", "SOL-001", "x", 1), ("grants", "SOL-002", "y", 2), ("nih", "SOL-001", "z", 3)])
    new = tables.upsert(old, df([("grants", "SOL-001", "new", 9)]), ["api_source", "solicitation_id"])
    assert {(r.api_source, r.solicitation_id): r.description for r in new.collect()}["grants", "SOL-001"] == "new" and new.count() == 3
    assert tables.count_purged(old, source="grants").first().removed == 2
    assert tables.count_purged(old, solicitation_id="SOL-001").first().removed == 2
    assert tables.count_purged(old, start="2024-01-02", end="2024-01-03").first().removed == 2


def test_taxonomy_version_is_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "tax")
    v1 = spark.createDataFrame([("ai", "v1")], "cet_id string, version string")
    tables.save_taxonomy(v1, path)
    with pytest.raises(ValueError, match="exists"):
        tables.save_taxonomy(v1, path, spark.read.parquet(path))


def test_table_detection():
    assert tables.detect_table([*schemas.AWARD_MODIFICATIONS.fieldNames(), "extra"]) == "award_modifications"
    assert tables.detect_table(["uei"]) is None


def test_synthetic_ids(spark):
    df = spark.createDataFrame([("", "F"), ("", "F"), (None, "G"), ("X", "F")], "award_id string, firm string").withColumn("n", F.monotonically_increasing_id())
    ids = sorted(r.award_id for r in ingest.dedup_first_synthetic(df, ["firm"], [F.col("n")]).collect())
    assert len(ids) == 3 and ids[-1] == "X" and all(i.startswith("SYNTH-") and len(i) == 22 for i in ids[:2])


def test_difference_and_intersection_read_each_table_once(spark):
    from techfolio.plans import all as _all  # noqa: F401
    from techfolio.plans.registry import QUERIES

    plan = QUERIES["x2_difference_and_intersection"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and "LeftAnti" not in plan and "LeftSemi" not in plan
    assert sum(line.count("Relation [l_orderkey") for line in plan.splitlines()) == 1
