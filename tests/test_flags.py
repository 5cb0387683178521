from datetime import datetime

from pyspark.sql import functions as F

from caseweave.operators import filters, flags, quality, review, views

def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


def flag_rows(spark, rows):
    return spark.createDataFrame([(*r, datetime(2024, 1, 1 + n)) for n, r in enumerate(rows)], "flag_id string, status string, severity string, title string, target_id string, jurisdiction_id string, confidence_score double, created_at timestamp")


def sample(spark):
    return flag_rows(spark, [
        ("f1", "PENDING", "HIGH", "Emerging trend: Theft in A", "t1", "A", 0.5),
        ("f2", "DISMISSED", "CRITICAL", "Emerging trend: Fraud in A", "t2", "A", 0.9),
        ("f3", "PENDING", "CRITICAL", "Spot", "t3", "B", 0.4),
        ("f4", "PENDING", "CRITICAL", "Spot", "t4", "B", 0.7),
    ])


def test_queue_order(spark):
    assert [r["flag_id"] for r in flags.review_queue(sample(spark)).collect()] == ["f4", "f3", "f1", "f2"]
    assert [r["flag_id"] for r in flags.review_queue(sample(spark), 1, only_pending=True, severity="critical").collect()] == ["f4"]


def test_pending_target_suppresses(spark):
    old = sample(spark)
    new = flag_rows(spark, [("n1", "PENDING", "LOW", "x", "t1", "A", 0.1), ("n2", "PENDING", "LOW", "x", "t2", "A", 0.1), ("n3", "PENDING", "LOW", "x", "t2", "A", 0.1)])
    assert [r["flag_id"] for r in flags.without_pending_target(new, old).collect()] == ["n2"]


def test_pending_type_suppresses_everywhere_or_by_region(spark):
    spikes = spark.createDataFrame([("Theft", "B", 10, 4.0, 150.0), ("Fraud", "A", 9, 4.0, 125.0), ("Arson", "A", 5, 4.0, 25.0)], "crime_type string, district string, current_count int, baseline_average double, spike_percentage double")
    made = flags.trend_flags(spikes, now(), "district")
    assert sorted(r["target_id"] for r in made.collect()) == ["Fraud", "Theft"]
    assert [r["target_id"] for r in flags.without_pending_type(made, sample(spark)).collect()] == ["Fraud"]
    assert flags.without_pending_type(made, sample(spark), with_region=True).count() == 2


def test_match_flag_bands(spark):
    df = spark.createDataFrame([("a", "b", 0.69), ("a", "c", 0.7), ("a", "d", 0.85)], "source string, target string, similarity_score double")
    assert sorted((r["target_id"], r["severity"]) for r in flags.match_flags(df, now()).collect()) == [("c", "MEDIUM"), ("d", "HIGH")]


def test_decisions(spark):
    asked = spark.createDataFrame(
        [("f1", "escalate", "far", "u"), ("f1", "maybe", " ", "u"), ("f9", "dismiss", "none", "u"), (None, None, None, "u")],
        "flag_id string, decision string, reason string, reviewer_id string",
    )
    good, bad = review.check_decisions(asked, sample(spark))
    assert [(r["flag_id"], r["decision"]) for r in good.collect()] == [("f1", "ESCALATE")]
    problems = {r["flag_id"]: [e["field"] for e in r["field_errors"]] for r in bad.collect()}
    assert problems == {"f1": ["decision", "reason"], "f9": ["flag_id"], None: ["flag_id", "decision", "reason"]}
    rows = review.decision_rows(good, now()).collect()
    assert rows[0]["reviewer_role"] == "SHO" and rows[0]["action_type"] is None
    assert rows[0]["decision_id"] == review.decision_rows(good, now()).first()["decision_id"]


def test_latest_decision_wins(spark):
    made = spark.createDataFrame(
        [("d1", "f1", "DISMISS", "no", datetime(2024, 2, 1)), ("d2", "f1", "ACKNOWLEDGE", "yes", datetime(2024, 2, 2))],
        "decision_id string, flag_id string, decision string, reason string, created_at timestamp",
    )
    got = {r["flag_id"]: r["status"] for r in review.current_flags(sample(spark), made).collect()}
    assert got == {"f1": "ACKNOWLEDGED", "f2": "DISMISSED", "f3": "PENDING", "f4": "PENDING"}
    routed = review.route(made, sample(spark))
    assert review.ground_actions(routed).count() == review.dismissals(routed).count() == 1 and review.notifications(routed).count() == 0


def test_intake_collects_every_error(spark):
    from caseweave.sources.schemas import INTAKE

    ok = ("F1", "theft", "2024-01-01", "2024-01-01", "", "u", (1.0, 2.0, "3", None), None, None)
    bad = (" ", "arson", "soon", None, "", None, (95.0, 2.0, "x", None), None, None)
    none = ("F2", "theft", "2024-01-01", "2024-01-01", "", "u", None, None, None)
    valid, rejected = quality.split_valid(spark.createDataFrame([ok, bad, none], INTAKE), quality.intake_rules())
    assert [r["fir_number"] for r in valid.collect()] == ["F1"]
    fields = {r["fir_number"]: [e["field"] for e in r["field_errors"]] for r in rejected.collect()}
    assert fields["F2"] == ["location"]
    assert fields[" "] == ["fir_number", "incident_type", "reported_at", "occurred_at", "created_by", "location.latitude/longitude", "location.district_id"]


def test_foreign_keys(spark):
    tables = {
        "districts": spark.createDataFrame([(1,)], "district_id int"),
        "locations": spark.createDataFrame([(1, 1), (2, 7), (3, None)], "location_id int, district_id int"),
    }
    assert [tuple(r) for r in quality.foreign_key_report(tables).collect()] == [("locations.district_id", "7", 1)]


def test_roles(spark):
    df = spark.createDataFrame([(1, "v", "n")], "incident_id int, victim_id string, victim_name string")
    assert filters.for_role(df, "constable").columns == ["incident_id"]
    assert filters.for_role(df, "SHO").columns == df.columns
    matrix = {r["role"]: r for r in filters.role_matrix(spark).collect()}
    assert matrix["sp"]["network_analysis"] and not matrix["dgp"]["network_analysis"] and matrix["dgp"]["plain_language_brief"]


def test_natural_order(spark):
    df = spark.createDataFrame([("S10",), ("S2",), ("S1",), ("A3",)], "s string")
    assert [r["s"] for r in filters.table_order(df, "s").collect()] == ["A3", "S1", "S2", "S10"]
    assert [r["s"] for r in filters.table_order(df, "s", True, 2).collect()] == ["S10", "S2"]


def test_period_comparison_without_base(spark):
    df = spark.createDataFrame([(datetime(2024, 3, 5),)], "occurrence_datetime timestamp")
    row = views.period_comparison(df, F.lit("2024-03-09").cast("timestamp")).first()
    assert (row["current_month"], row["previous_month"], row["change_pct"]) == (1, 0, None)


def test_flag_filters_ignore_case(spark):
    got = flags.filter_flags(sample(spark), status="pending", severity="critical", jurisdiction="B")
    assert sorted(r["flag_id"] for r in got.collect()) == ["f3", "f4"]
    assert flags.filter_flags(sample(spark), jurisdiction="b").isEmpty()
