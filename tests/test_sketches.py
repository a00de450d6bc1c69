"""Kept sketches against exact quantiles and exact drift."""

from __future__ import annotations

import json

import numpy as np
import pytest
from conftest import SAMPLES
from pyspark.sql import functions as F

from lodgecast.operators import analysis as A
from lodgecast.operators import clean as C
from lodgecast.plans import sketches as S
from lodgecast.plans.storage import stored
from lodgecast.streaming import scoring as T


@pytest.fixture(scope="module")
def readings(spark):
    """A third of the rows on one day; heavy ties, nulls and NaN; one empty column."""
    value = F.when(F.col("id") % 4 == 0, 7.0).otherwise((F.xxhash64("id") % 100_000) / 10.0)
    return stored(
        spark.range(0, 30_000).select(
            F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 29).cast("int").alias("day"),
            F.when(F.col("id") % 50 == 1, None).when(F.col("id") % 50 == 2, F.lit(float("nan"))).otherwise(value).alias("a"),
            (F.col("id") % 3).cast("int").alias("b"),
            F.lit(None).cast("double").alias("c"),
        )
    )


def shares_below(values, q):
    return (values < q).mean(), (values <= q).mean()


def test_merged_quantiles_keep_the_bound(spark, readings, tmp_path):
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    by_day = S.sketch_columns(readings, ["a", "b", "c"], ["day"])
    for part in range(3):
        S.keep_sketches(by_day.filter(F.col("day") % 3 == part), str(tmp_path), f"part-{part}")
    S.keep_sketches(by_day.filter("day % 3 = 1"), str(tmp_path), "part-1")  # again: replaced
    kept = S.kept_sketches(spark, str(tmp_path))
    assert {r["run"] for r in kept.select("run").distinct().collect()} == {"part-0", "part-1", "part-2"}
    merged = S.merge_sketches(kept).select("feature", "rows", "missing", S.quantiles_of(shares).alias("q"))
    found = {r["feature"]: r for r in merged.collect()}
    assert (found["c"]["rows"], found["c"]["missing"], found["c"]["q"]) == (0, 30_000, None)
    assert (found["a"]["rows"], found["a"]["missing"]) == (28_800, 1_200)
    for name in ("a", "b"):
        values = np.array([r[0] for r in readings.select(name).collect() if r[0] is not None and r[0] == r[0]])
        for share, q in zip(shares, found[name]["q"]):
            low, high = shares_below(values, q)
            assert low - S.rank_error() <= share <= high + S.rank_error()
    days = S.merge_sketches(kept, ["day"]).groupBy("day").count().collect()
    assert len(days) == 29 and {r["count"] for r in days} == {3}


def test_few_values_are_exact(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 1, 9, 3)], "v double")
    one = S.sketch_columns(df, ["v"]).select(
        S.quantiles_of([0.2, 0.5, 1.0]).alias("q"), S.shares_up_to([0.0, 1.0, 4.0]).alias("r")
    ).first()
    assert one["q"] == [1.0, 3.0, 9.0] and one["r"] == [0.0, 0.4, 0.6]
    assert S.sketch_columns(df.limit(0), ["v"]).count() == 0


def test_sketched_drift_is_near_the_exact_one(readings):
    moved = readings.withColumn("a", F.when(F.col("day") > 9, F.col("a") + 900).otherwise(F.col("a"))).filter("day <> 5")
    exact = {r["feature"]: r for r in A.feature_drift(readings, moved, ["a", "b"]).collect()}
    sketches = [stored(S.sketch_columns(x, ["a", "b"])) for x in (readings, moved)]
    found = {r["feature"]: r for r in A.sketched_drift(*sketches).collect()}
    for name in ("a", "b"):
        assert found[name]["psi"] == pytest.approx(exact[name]["psi"], abs=0.02)
        assert found[name]["buckets"] == exact[name]["buckets"]
    assert exact["a"]["psi"] > 0.05
    same = {r["feature"]: r["psi"] for r in A.sketched_drift(sketches[0], sketches[0]).collect()}
    assert same == {"a": 0.0, "b": 0.0}
    lost = {r["feature"]: r["psi"] for r in A.sketched_drift(sketches[0], sketches[1].filter("feature = 'b'")).collect()}
    assert lost["a"] > 1


def test_medians_from_kept_sketches(spark, bookings):
    days = [bookings(*[{"average_price": float(p), "lead_time": p} for p in ps]) for ps in ((1, 9), (2, 3, 4))]
    kept = [S.sketch_columns(d, ["average_price"]) for d in days]
    stats = C.imputation_stats(days[0], sketches=kept[0].unionByName(kept[1]))
    assert stats.first()["average_price"] == 3.0 and stats.first()["room_type"] == "Room_Type 1"
    assert "lead_time" not in stats.columns


def test_drift_of_stream_batches(spark, bookings, tmp_path):
    history = bookings(*[{"booking_id": str(i), "lead_time": i} for i in range(100)])
    reference = stored(S.sketch_columns(C.booking_features(C.parse_reservation_date(history)), ["lead_time"]))

    def send(name, leads):
        document = {"bookings": [{**SAMPLES[0], "Booking_ID": f"{name}-{i}", "lead time": x} for i, x in enumerate(leads)]}
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(json.dumps(document))
        T.stream_feature_drift(
            T.request_stream(spark, str(tmp_path / "in")), reference, ["lead_time"], str(tmp_path / "out"), str(tmp_path / "state")
        ).awaitTermination()

    send("1.json", range(100))
    send("2.json", [300] * 50)
    drift = {r["batch_id"]: r for r in spark.read.parquet(str(tmp_path / "out" / "drift")).collect()}
    assert [drift[k]["rows"] for k in (0, 1)] == [100, 50] and drift[0]["psi"] == 0.0 and drift[1]["psi"] > 1
    whole = S.merge_sketches(S.kept_sketches(spark, str(tmp_path / "out" / "sketches"))).first()
    assert whole["rows"] == 150
