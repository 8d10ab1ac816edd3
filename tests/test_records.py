import datetime

from pyspark.sql import functions as F

from millrace.functions.records import parse_amount, parse_date
from millrace.functions.text import client_key, normalise_currency, strip, unmask_null
from millrace.operators.records import clean_records, divergence, keep_latest
from millrace.operators.validation import budget_checks, report, validate

NAMES = "budget_id string, client_name string, client_code string, total_amount string, currency string, hours_estimated string, signed_at string, status string"
ROW = ("BUDGET-2024-0001", "Acme Corp", None, "80000", "EUR", "1280", "2024-03-15", "signed")


def of(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


def changed(spark, *overrides):
    names = [c.split()[0] for c in NAMES.split(", ")]
    return spark.createDataFrame([tuple(dict(zip(names, ROW, strict=True), **o).values()) for o in overrides], NAMES)


def test_amounts(spark):
    same = ["80000", "80000.0", "80.000,00", "80,000.00", "80000 €", "$80,000", " 80.000 "]
    assert {r[0] for r in of(spark, same).select(parse_amount(F.col("v"))).collect()} == {80000.0}
    odd = of(spark, [None, "", "tbd", "1.2.3,4", "-1.234,5"]).select(parse_amount(F.col("v"))).collect()
    assert [r[0] for r in odd] == [None, None, None, None, -1234.5]


def test_dates(spark):
    day = datetime.datetime(2024, 3, 15)
    same = ["2024-03-15", "15/03/2024", "Mar 15 2024", "15-03-2024", "2024/3/15", "15 Mar 2024", " 2024-3-15 "]
    assert {r[0] for r in of(spark, same).select(parse_date(F.col("v"))).collect()} == {day}
    assert {r[0] for r in of(spark, [None, "", "soon", "2024-13-01", "31/02/2024", "15 March 2024", "20240315"]).select(parse_date(F.col("v"))).collect()} == {None}


def test_names_currencies_and_nulls(spark):
    assert {r[0] for r in of(spark, ["EUR", "eur", "€", " euros "]).select(normalise_currency(F.col("v"))).collect()} == {"EUR"}
    assert {r[0] for r in of(spark, ["ACME Corp.", "Acme Corp", "acme corp", "Acme S.L.", "ACME"]).select(client_key(F.col("v"))).collect()} == {"acme"}
    assert [r[0] for r in of(spark, ["S.L.", None]).select(client_key(F.col("v"))).collect()] == [None, None]
    assert {r[0] for r in of(spark, ["N/A", "n/a", "-", "", "  ", "TBD", "pendiente", "unknown", " ", None]).select(unmask_null(F.col("v"))).collect()} == {None}
    assert of(spark, ["  a b\t\n"]).select(strip(F.col("v"))).first()[0] == "a b"


def test_routing(spark):
    faults = [{}, {"total_amount": "-50000"}, {"total_amount": "99000000"}, {"signed_at": "2099-01-01"}, {"budget_id": "BDG_2024_12"}, {"client_name": "N/A"}, {"total_amount": "0"}]
    now = F.lit("2026-01-01").cast("timestamp")
    clean = clean_records(changed(spark, *faults))
    got = [(r["outcome"], r["failures"]) for r in validate(clean, budget_checks(now)).collect()]
    assert [o for o, _ in got[:5]] == ["valid", "discarded", "discarded", "discarded", "discarded"]
    assert got[5][0] == "quarantined" and any("client_name" in f for f in got[5][1]) and got[6][0] != "valid"
    assert {r["outcome"] for r in validate(clean, budget_checks(now), "permissive").collect()} == {"valid", "quarantined"}
    none = report(validate(clean.limit(0), budget_checks(now))).first()
    assert none["total"] == 0 and none["pass_rate"] == 0


def test_versions(spark):
    rows = changed(spark, {"total_amount": "48750", "signed_at": "2024-03-12"}, {"total_amount": "52500", "signed_at": "2024-05-02"}, {"total_amount": "1", "signed_at": None}, {"budget_id": None}, {"budget_id": None})
    clean = clean_records(rows).withColumn("record", F.monotonically_increasing_id())
    kept = {r["budget_id"]: r["total_amount"] for r in keep_latest(clean).collect()}
    assert kept == {"BUDGET-2024-0001": 52500.0, None: 80000.0}
    both = {r["budget_id"]: (r["versions"], r["distinct_versions"], r["exact_duplicates"]) for r in divergence(clean).collect()}
    assert both == {"BUDGET-2024-0001": (3, 3, 0), None: (2, 1, 1)}
