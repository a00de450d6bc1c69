"""Files, request documents, run tables and saved models."""

from __future__ import annotations

import json

import pytest
from conftest import SAMPLES, SMALL, rows
from pyspark.sql import functions as F

from lodgecast.operators import clean as C
from lodgecast.operators import rank as R
from lodgecast.operators.validate import BAD_SHARE, validate_requests
from lodgecast.plans.storage import stored
from lodgecast.schemas import CANONICAL_TO_WIRE, POSITION, WIRE_TO_CANONICAL
from lodgecast.session import scratch_root
from lodgecast.sinks import files, tables
from lodgecast.sources import bookings as B
from lodgecast.sources import requests as Q

HEADER = [w for w in WIRE_TO_CANONICAL if w != "booking status"]


def write_csv(path, lines, header=HEADER):
    path.write_text("\n".join([",".join(header), *lines]) + "\n")
    return str(path)


def test_csv_cells(spark, tmp_path):
    path = write_csv(
        tmp_path / "b.csv",
        [
            "INN00001,1,1,2,5,Not Selected,0,Room_Type 1,224,Offline,0,0,0,88.0,0,10/2/2015",
            "INN00002,NA,,2,5,null,0,None,x,Online,0,0,0,nan,0,",
        ],
    )
    first, second = B.read_bookings_csv(spark, path, labelled=False).collect()
    assert first["type_of_meal"] == "Not Selected" and first["average_price"] == 88.0
    for name in (
        "number_of_adults", "number_of_children", "type_of_meal", "room_type", "lead_time",
        "average_price", "date_of_reservation",
    ):
        assert second[name] is None, name
    assert second["market_segment_type"] == "Online"


def test_csv_columns_are_found_by_name(spark, tmp_path):
    header = list(reversed(HEADER))
    line = ",".join(str(SAMPLES[0][h]) for h in header)
    df = B.read_bookings_csv(spark, write_csv(tmp_path / "b.csv", [line], header), labelled=False)
    assert df.first()["booking_id"] == "INN00001" and df.first()["lead_time"] == 45.0
    with pytest.raises(ValueError):
        B.read_bookings_csv(spark, write_csv(tmp_path / "c.csv", [line], header), labelled=True)


def test_rows_without_ids_are_numbered_in_file_order(spark, tmp_path):
    """Rows without a readable date go first, then ids are given along the file."""
    header = [h for h in HEADER if h != "Booking_ID"]
    lines = [
        f"1,1,2,5,Meal Plan 1,0,Room_Type 1,{i},Offline,0,0,0,88.0,0,{'bad' if i % 10 == 3 else '10/2/2015'}"
        for i in range(300)
    ]
    path = write_csv(tmp_path / "b.csv", lines, header)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        df = B.read_bookings_csv(spark, path, labelled=False, position=True)
        assert df.rdd.getNumPartitions() > 2
        frame = C.preprocess_bookings(df, is_training=False).frame
        numbered = R.assign_missing_ids(frame.select(POSITION, "lead_time"))
        found = [(r["booking_id"], r["lead_time"]) for r in numbered.orderBy("booking_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == list(enumerate([float(i) for i in range(300) if i % 10 != 3], 1))


def test_renaming_goes_both_ways(bookings):
    df = bookings({}, labelled=True)
    wire = B.rename_bookings(df, "wire")
    assert wire.columns == list(WIRE_TO_CANONICAL)
    assert B.rename_bookings(wire).columns == df.columns
    assert CANONICAL_TO_WIRE["previous_not_canceled"] == "P-not-C"
    with pytest.raises(ValueError):
        B.rename_bookings(df, "other")


def test_request_documents(spark, tmp_path):
    canonical = {WIRE_TO_CANONICAL[k]: v for k, v in SAMPLES[1].items()}
    wrong = {**SAMPLES[0], "lead time": 3.5, "repeated": "1", "P-C": 2.0}
    wrong.pop("Booking_ID")
    documents = [
        {"request_id": "r1", "bookings": [SAMPLES[0], canonical], "risk_share": 0.5},
        {"bookings": [wrong]},
    ]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(d) for d in documents))
    found = Q.read_booking_requests(spark, str(tmp_path / "r.json")).orderBy("lead_time").collect()
    assert [r["booking_id"] for r in found] == [None, "INN00001", "INN00099"]
    assert found[0]["lead_time"] is None and found[0]["repeated"] == 1
    assert found[0]["previous_cancellations"] == 2 and found[0]["risk_share"] == 0.3
    assert found[0]["request_id"] is None
    assert found[0]["document_id"] != found[1]["document_id"] == found[2]["document_id"]
    assert found[2]["request_id"] == "r1" and found[2]["average_price"] == 220.0


def test_no_document_is_lost(spark, tmp_path):
    """In = valid + rejected, whatever was sent."""
    good = {"request_id": "r", "bookings": [SAMPLES[0]]}
    lines = [
        json.dumps(good), json.dumps(good), "not json", "[]", "7", "{}", '{"bookings": []}',
        '{"bookings": {"a": 1}}', '{"bookings": [3]}', json.dumps({**good, "risk_share": "abc"}),
        json.dumps({**good, "risk_share": None}), json.dumps({**good, "risk_share": "0.5"}), "",
        json.dumps({"bookings": [{**SAMPLES[0], "type of meal": 5, "Booking_ID": 7}]}),
        json.dumps({"request_id": None, "bookings": [{**SAMPLES[0], "lead time": -5}]}),
    ]
    (tmp_path / "r.json").write_text("\n".join(lines))
    bookings, broken = Q.read_requests(spark, str(tmp_path / "r.json"))
    valid, invalid = validate_requests(bookings)
    kept = sorted((r["document_id"], r["request_id"], r["risk_share"]) for r in valid.collect())
    assert [(r, s) for _, r, s in kept] == [("r", 0.3), ("r", 0.3), ("r", 0.5)]
    assert len({d for d, _, _ in kept}) == 3
    errors = sorted(e for r in broken.collect() for e in r["errors"])
    assert errors == sorted(
        [Q.NO_JSON, Q.NO_OBJECT, Q.NO_OBJECT, Q.NO_BOOKINGS, Q.EMPTY_LIST, Q.NO_LIST]
    )
    reasons = sorted(tuple(r["errors"])[:2] for r in invalid.collect())
    assert reasons == sorted([
        ("number_of_adults: Field required", "number_of_children: Field required"),
        (BAD_SHARE,), (BAD_SHARE,),
        (f"booking_id: {Q.NO_TEXT}", f"type_of_meal: {Q.NO_TEXT}"),
        ("lead_time: Value must be non-negative",),
    ])


def test_documents_over_several_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"bookings": [SAMPLES[0]] * 2}, indent=2))
    bookings, broken = Q.read_requests(spark, str(tmp_path / "r.json"), multiline=True)
    assert bookings.count() == 2 and broken.count() == 0
    bookings, broken = Q.read_requests(spark, str(tmp_path / "r.json"))
    assert bookings.count() == 0 and broken.count() > 10


def test_csv_rows_of_another_length_fail(spark, tmp_path):
    line = ",".join(str(SAMPLES[0][h]) for h in HEADER)
    broken = line.replace("Meal Plan 1", '"Meal\nPlan 1"')
    path = write_csv(tmp_path / "b.csv", [line, broken])
    with pytest.raises(Exception, match="(?i)malformed"):
        B.read_bookings_csv(spark, path, labelled=False).collect()
    read = B.read_bookings_csv(spark, path, labelled=False, multiline=True)
    assert sorted(r["type_of_meal"] for r in read.collect()) == ["Meal\nPlan 1", "Meal Plan 1"]


def scores(spark):
    return R.build_scoring_table(
        spark.createDataFrame([("a", 0.9), (None, 0.1)], f"booking_id string, {R.PROBABILITY} double")
    )


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_score_files(spark, tmp_path, fmt):
    files.write_scores(scores(spark), str(tmp_path / "s"), fmt)
    files.write_high_risk(scores(spark), str(tmp_path / "h"), fmt)
    read = spark.read.option("header", True).format(fmt)
    assert read.load(str(tmp_path / "s")).count() == 2
    assert rows(read.load(str(tmp_path / "h")), "booking_id") == [("a",)]
    with pytest.raises(ValueError):
        files.write_processed(scores(spark), str(tmp_path / "x"), "xml")


def test_run_tables(spark, tmp_path):
    tables.ensure_run_tables(spark, "lodge_test", str(tmp_path / "db"))
    tables.ensure_run_tables(spark, "lodge_test", str(tmp_path / "db"))
    for run in ("r1", "r2", "r1"):
        tables.append_predictions(scores(spark), "lodge_test.predictions", "GBT", run)
    saved = spark.table("lodge_test.predictions")
    assert saved.count() == 4 and saved.filter("run_id = 'r1'").count() == 2
    assert saved.schema["is_high_risk"].dataType.simpleString() == "boolean"
    assert rows(saved.filter("run_id = 'r2'"), "booking_id", "is_high_risk") == [
        ("None", False), ("a", True),
    ]
    assert saved.filter("created_at IS NULL OR created_at > current_timestamp()").count() == 0

    long = spark.createDataFrame([("m", 1.0)], "metric_name string, metric_value double")
    for _ in range(2):
        tables.append_monitoring(long, "lodge_test.monitoring_metrics", "train", "GBT", "r1")
    assert spark.table("lodge_test.monitoring_metrics").count() == 1

    metrics = spark.createDataFrame([(0.8, 0.6, 0.7)], "accuracy double, f1 double, roc_auc double")
    tables.append_model_run(
        metrics, {"name": "модель"}, "lodge_test.model_runs", "GBT", "gbt_1", "r1"
    )
    run = spark.table("lodge_test.model_runs").first()
    assert json.loads(run["parameters_json"]) == {"name": "модель"} and "модель" in run["parameters_json"]
    with pytest.raises(ValueError):
        tables.append_monitoring(long, "lodge_test.monitoring_metrics", "train", "GBT", "x' or 1")


def test_stored_frames_live_in_the_shared_folder(spark):
    df = stored(spark.range(10).withColumn("x", F.lit("a")))
    assert df.count() == 10
    assert all(scratch_root(spark).rstrip("/") in f for f in df.inputFiles())


def test_a_run_that_ended_half_way_is_not_seen(spark, tmp_path, monkeypatch):
    from lodgecast import jobs
    from lodgecast.operators import train as M
    from lodgecast.sinks import tables
    from lodgecast.sources.orders import bookings_from_orders, labelled_bookings, new_bookings

    database, model, out = "lodge_half", str(tmp_path / "model"), str(tmp_path / "out")
    tables.ensure_run_tables(spark, database, str(tmp_path / "db"))
    bookings = stored(bookings_from_orders(spark, SMALL))
    quick = {**M.FULL_PARAMS, "maxIter": 2, "maxDepth": 2}
    jobs.run_training(labelled_bookings(bookings), model, database, "train-1", quick)
    assert tables.finished(spark, database, "model_runs").count() == 1
    assert tables.finished(spark, database, "monitoring_metrics").count() == 9

    def batch(run_id):
        jobs.run_batch(new_bookings(bookings), model, out, database, run_id)

    def seen():
        rows = tables.finished(spark, database, "predictions").groupBy("run_id").count().collect()
        runs = tables.finished(spark, database, "monitoring_metrics").filter("run_type = 'batch_predict'")
        assert {r["run_id"] for r in rows} == {r["run_id"] for r in runs.select("run_id").distinct().collect()}
        return {r["run_id"]: r["count"] for r in rows}

    batch("b-1")
    n = seen()["b-1"]
    with monkeypatch.context() as broken:
        broken.setattr(jobs, "append_monitoring", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        for run_id in ("b-2", "b-1"):  # a new run, and a finished one that is begun again
            with pytest.raises(OSError):
                batch(run_id)
        assert seen() == {} and spark.table(f"{database}.predictions").count() == 2 * n
    batch("b-2")
    assert seen() == {"b-2": n}
    batch("b-1")
    assert seen() == {"b-1": n, "b-2": n}
    listed = spark.table(f"{database}.finished_runs").filter("run_id = 'b-1'").first()
    assert listed["rows_json"] == f'{{"monitoring_metrics": 10, "predictions": {n}}}'
