"""Streams of request files, stopped and started again."""

from __future__ import annotations

import json

from conftest import SAMPLES

from lodgecast.operators import clean as C
from lodgecast.operators.analysis import score_scorecard
from lodgecast.sinks.tables import ensure_run_tables
from lodgecast.streaming import scoring as T


def put(folder, name, *documents):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(d) for d in documents))


def request(name, *prices, share=0.5):
    bookings = [
        {**SAMPLES[0], "Booking_ID": f"{name}-{i}", "average price": p} for i, p in enumerate(prices)
    ]
    return {"request_id": name, "bookings": bookings, "risk_share": share}


def test_single_scores_continue_after_a_restart(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        requests = T.request_stream(spark, str(source))
        T.stream_score_single(requests, score_scorecard, out, state, threshold=0.2).awaitTermination()
        return sorted(r["booking_id"] for r in spark.read.parquet(out).collect())

    bad = {**request("c", 1.0), "bookings": [{**SAMPLES[0], "lead time": -1}]}
    put(source, "1.json", request("a", 10.0, 20.0), bad)
    assert run() == ["a-0", "a-1"]
    assert run() == ["a-0", "a-1"]
    put(source, "2.json", request("b", 30.0))
    assert run() == ["a-0", "a-1", "b-0"]


def test_gaps_are_filled_from_stored_statistics(spark, bookings, tmp_path):
    source = tmp_path / "in"
    gappy = request("a", 10.0, None)
    gappy["bookings"][0].pop("type of meal")
    put(source, "1.json", gappy)
    stats = C.imputation_stats(bookings({}))
    for name, given, kept in (("with", stats, 2), ("without", None, 0)):
        requests = T.request_stream(spark, str(source))
        out = str(tmp_path / f"out-{name}")
        T.stream_score_single(
            requests, score_scorecard, out, str(tmp_path / f"state-{name}"), stats=given
        ).awaitTermination()
        assert spark.read.schema("booking_id string").parquet(out).count() == kept


def test_requests_are_ranked_and_measured_once(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    ensure_run_tables(spark, "lodge_stream", str(tmp_path / "db"))
    table = "lodge_stream.monitoring_metrics"

    def run():
        requests = T.request_stream(spark, str(source))
        T.stream_score_requests(
            requests, score_scorecard, out, state, metrics_table=table, stream_name="stream"
        ).awaitTermination()
        return {r["booking_id"]: (r["rank"], r["is_high_risk"]) for r in spark.read.parquet(out).collect()}

    put(source, "1.json", request("a", 10.0, 900.0), request("bad", 5.0, share=1.5))
    assert run() == {"a-1": (1, 1), "a-0": (2, 0)}
    put(source, "2.json", request("b", 30.0))
    assert run() == {"a-1": (1, 1), "a-0": (2, 0), "b-0": (1, 1)}
    counts = spark.table(table).filter("metric_name = 'predictions_count'")
    assert sorted((r["run_id"], r["metric_value"]) for r in counts.collect()) == [
        ("stream-0", 2.0), ("stream-1", 1.0),
    ]
