"""Distributed plan shapes against brute force, with hot keys and small limits."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodgecast.plans import segments
from lodgecast.plans.history import earlier_totals
from lodgecast.plans.joins import lookup_join
from lodgecast.plans.numbering import number_rows
from lodgecast.plans.selection import count_values, exact_quantiles, order_statistics
from lodgecast.plans.storage import stored


def test_numbers_are_positions_even_for_equal_rows(spark):
    draw = random.Random(1)
    data = [(draw.choice([0.1, 0.2, 0.2, 0.9]), f"id{draw.randrange(40)}") for _ in range(3000)]
    df = spark.createDataFrame(data, "p double, id string").repartition(7)
    found = number_rows(df, [F.col("p").desc(), F.col("id").asc()]).collect()
    assert sorted(r["position"] for r in found) == list(range(1, 3001))
    assert {r["group_rows"] for r in found} == {3000}
    by_rank = [(r["p"], r["id"]) for r in sorted(found, key=lambda r: r["position"])]
    assert by_rank == sorted(data, key=lambda r: (-r[0], r[1]))


def test_numbers_within_groups_with_a_hot_group(spark):
    draw = random.Random(2)
    data = [("hot" if i % 3 else f"g{i % 50}", draw.randrange(5), i) for i in range(4000)]
    df = spark.createDataFrame(data, "g string, v int, i int")
    found = number_rows(df, [F.col("v").asc(), F.col("i").asc()], within=["g"]).collect()
    groups = {}
    for g, v, i in data:
        groups.setdefault(g, []).append((v, i))
    expected = {
        (g, v, i): (place, len(members))
        for g, members in groups.items()
        for place, (v, i) in enumerate(sorted(members), 1)
    }
    assert {(r["g"], r["v"], r["i"]): (r["position"], r["group_rows"]) for r in found} == expected


def test_a_hot_group_spreads_over_sort_slices(spark):
    """All rows in one group, all equal: numbering still uses several slices."""
    df = spark.range(0, 20_000).select(F.lit("one").alias("g"), F.lit(0.5).alias("p"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = number_rows(df, [F.col("p").desc()], within=["g"])
        assert ranked.agg(F.max("position"), F.count_distinct("position")).first() == (20_000, 20_000)
        plan = ranked._jdf.queryExecution().optimizedPlan().toString()
        written = [f for f in ranked.inputFiles() if "numbering-sorted" in f]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "Window" in plan and len(written) > 1


def test_numbering_has_no_single_partition_exchange_of_rows(spark):
    df = spark.range(0, 1000).select(F.rand(3).alias("p"), F.col("id"))
    ranked = number_rows(df, [F.col("p").desc()])
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # The one SinglePartition exchange holds the slice counts, below the broadcast.
    assert plan.count("SinglePartition") == 1
    before = plan[: plan.index("SinglePartition")]
    assert "BroadcastExchange" in before and "Window" in before


def test_numbering_of_an_empty_frame(spark):
    df = spark.createDataFrame([], "p double, id string")
    assert number_rows(df, [F.col("p").desc()]).count() == 0


@pytest.mark.parametrize("limit", [50, 10_000])
def test_order_statistics_of_tied_and_continuous_values(spark, limit):
    draw = random.Random(3)
    data = []
    for _ in range(5000):
        a = draw.choice([1.0] * 5 + [2.0] * 4 + [draw.uniform(0, 3)])
        data.append((a, draw.gauss(0, 1e6), draw.randrange(2**52), None if draw.random() < 0.3 else 7.0))
    df = spark.createDataFrame(data, "a double, b double, h long, c double")
    counts = count_values(df, ["a", "b", "h", "c"])
    wanted = {"a": [0, 2499, 2500, 4999], "b": [17, 2500], "h": [1000, 4999], "c": [0]}
    found = order_statistics(df, wanted, counts, limit)
    for place, name in enumerate("abhc"):
        values = sorted(r[place] for r in data if r[place] is not None)
        for index in wanted[name]:
            assert found[name, index] == values[index], (name, index)


def test_half_and_half_ties_end(spark):
    """Two values share all rows: the interval cannot shrink by quantiles alone."""
    df = spark.range(0, 4001).select(F.when(F.col("id") % 2 == 0, 1.0).otherwise(2.0).alias("x"))
    counts = count_values(df, ["x"])
    found = order_statistics(df, {"x": [2000, 2001]}, counts, limit=10)
    assert found == {("x", 2000): 1.0, ("x", 2001): 2.0}


def test_order_statistics_rejects_a_place_outside(spark):
    df = spark.range(5)
    with pytest.raises(ValueError):
        order_statistics(df, {"id": [5]}, {"id": 5})


@pytest.mark.parametrize("limit", [20, 10_000])
def test_quantiles_match_linear_interpolation(spark, limit):
    draw = random.Random(4)
    values = [draw.choice([0.0, draw.uniform(-5, 5)]) for _ in range(999)]
    df = spark.createDataFrame([(v, None) for v in values], "v double, empty double")
    found = exact_quantiles(df, ["v", "empty"], [0.0, 0.25, 0.5, 0.9, 1.0], limit)
    assert found["empty"] == [None] * 5
    assert np.allclose(found["v"], np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0]))


def test_earlier_totals_match_a_plain_window(spark):
    draw = random.Random(5)
    data = [
        (i, 1 if draw.random() < 0.4 else draw.randrange(9), f"2024-01-{draw.randrange(1, 9):02d} {draw.randrange(24):02d}:00:00", draw.randrange(3))
        for i in range(800)
    ]
    df = spark.createDataFrame(data, "i int, k int, t string, x int").withColumn(
        "t", F.to_timestamp("t")
    )
    found = earlier_totals(df, "k", "t", {"n": F.lit(1), "s": F.col("x")}, ["i"])
    result = {r["i"]: (r["n"], r["s"]) for r in found.collect()}
    for i, k, t, _ in data:
        earlier = [r for r in data if r[1] == k and (r[2], r[0]) < (t, i)]
        assert result[i] == (len(earlier), sum(r[3] for r in earlier))


def _hot_days(spark):
    """A third of the rows on one day of one key, many of them at one moment; some moments equal."""
    draw = random.Random(6)
    data = []
    for i in range(3000):
        k, day, hour = (1, 3, draw.choice([5, 5, 7])) if i % 3 else (draw.randrange(40), draw.randrange(1, 9), draw.randrange(24))
        data.append((i, k, f"2024-01-{day:02d} {hour:02d}:00:00", draw.randrange(5), None if i % 7 else 1.5))
    df = spark.createDataFrame(data, "i int, k int, t string, x int, y double")
    return df.withColumn("t", F.to_timestamp("t"))


@pytest.mark.parametrize("most", [7, 300, 5_000])
def test_a_hot_day_is_cut_into_slices(spark, most):
    df = _hot_days(spark)
    sums = {"n": F.lit(1).cast("long"), "s": F.col("x"), "y_sum": F.col("y")}
    found = earlier_totals(df, "k", "t", sums, ["i"], most=most)
    earlier = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, -1)
    plain = df.select("*", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(n) for n, v in sums.items()])
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.select(*found.columns).collect()))
    windows = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x]
    assert any("_slice" in x for x in windows) == (most < 5_000)


def test_no_slice_holds_a_large_group(spark, monkeypatch):
    """The rows that one window of a group orders are about ``most``, whatever the group's size."""
    written = {}
    monkeypatch.setattr(segments, "stored", lambda df, label: written.setdefault(label, stored(df, label)))
    df = _hot_days(spark).withColumn("day", F.to_date("t"))
    counts = df.groupBy("k", "day").agg(F.count(F.lit(1)).alias("_rows"))
    segments.totals_before(df, ["k", "day"], ["t", "i"], {"n": F.lit(1)}, counts, most=100).count()
    sizes = [r["count"] for r in written["slices"].groupBy("k", "day", "_slice").count().collect()]
    assert sum(sizes) > 2000 and len(sizes) >= 15 and max(sizes) < 400


def test_lookup_join_is_the_same_salted_or_broadcast(spark):
    left = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 40).alias("k"), "id"
    )
    table = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    for how in ("inner", "left", "left_anti", "left_semi"):
        small = lookup_join(left, table, ["k"], how)
        salted = lookup_join(left, table, ["k"], how, broadcast_rows=5, salts=4)
        plain = left.join(table, "k", how)
        expected = sorted(map(repr, map(tuple, plain.collect())))
        assert sorted(map(repr, map(tuple, small.select(*plain.columns).collect()))) == expected
        assert sorted(map(repr, map(tuple, salted.select(*plain.columns).collect()))) == expected


def test_missing_groups_and_keys_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "g string, v int")
    found = number_rows(df, [F.col("v").asc()], within=["g"]).collect()
    assert sorted((r["v"], r["position"], r["group_rows"]) for r in found) == [
        (1, 1, 1), (2, 1, 2), (3, 2, 2),
    ]
    dated = df.withColumn("t", F.when(F.col("v") != 3, F.to_timestamp(F.lit("2024-01-01 00:00:00"))))
    totals = earlier_totals(dated, "g", "t", {"n": F.lit(1)}, ["v"])
    assert sorted((r["v"], r["n"]) for r in totals.collect()) == [(1, 0), (2, 0), (3, 0)]


def test_scoped_intermediates_are_deleted(spark):
    import os

    from lodgecast.session import scratch_scope

    with scratch_scope(spark):
        path = stored(spark.range(3)).inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path)
    assert not os.path.exists(path)


def test_scratch_folder_without_the_setting():
    from types import SimpleNamespace

    from lodgecast.session import scratch_root

    def session(master):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: default),
            sparkContext=SimpleNamespace(master=master, applicationId="app-1"),
        )

    local = scratch_root(session("local[2]"))
    assert local == scratch_root(session("local[2]")) and local.endswith("lodgecast-app-1")
    with pytest.raises(ValueError):
        scratch_root(session("yarn"))


def test_a_lookup_of_many_rows_is_not_built_on_the_driver(spark):
    """Tables of tens of thousands of values, several in one plan, are joined by shuffle."""
    left = stored(spark.range(100).select((F.col("id") % 7).cast("string").alias("k"), "id"))
    table = stored(spark.range(30_000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")))
    for known in (None, 30_000):
        joined = lookup_join(left, table, ["k"], "left", rows_known=known)
        hinted = joined._jdf.queryExecution().analyzed().toString()
        assert "strategy=broadcast" not in hinted
        assert joined.filter("v = 1").count() == 100
    small = lookup_join(left, table, ["k"], "left", rows_known=7)
    assert "strategy=broadcast" in small._jdf.queryExecution().analyzed().toString()


def test_a_salted_table_is_never_broadcast_by_spark(spark, monkeypatch):
    """Its files are small, so Spark would build all its repeated rows on the driver."""
    from lodgecast.plans import joins

    left = stored(spark.range(3000).select((F.col("id") % 50).cast("string").alias("k"), "id"))
    table = stored(spark.range(40).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")))
    for repeated in (joins.SALTED_ROWS, 100, 10):  # 4 salts, 2, and none for want of room
        monkeypatch.setattr(joins, "SALTED_ROWS", repeated)
        for known in (None, 40):
            joined = lookup_join(left, table, ["k"], "left", broadcast_rows=5, salts=4, rows_known=known)
            assert joined.filter("v = 1").count() == 2400 and joined.count() == 3000
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_label_rates_of_many_values_are_joined_by_shuffle(spark, monkeypatch):
    from lodgecast.operators.encode import fit_label_rates
    from lodgecast.plans import joins

    df = spark.range(2000).select(
        F.col("id").cast("string").alias("booking_id"), (F.col("id") % 700).cast("string").alias("client"),
        (F.col("id") % 2).cast("int").alias("booking_status"),
    )
    train = stored(df)
    expected = sorted(map(tuple, fit_label_rates(train, ["client"])[1].collect()))
    monkeypatch.setattr(joins.lookup_join, "__defaults__", ("inner", 50, 4, None))
    rates, others = fit_label_rates(train, ["client"])
    assert sorted(map(tuple, others.collect())) == expected
    for frame in (others, rates.transform(train)):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_many_groups_are_joined_by_shuffle(spark, monkeypatch):
    """Neither the rows nor the places of their groups are built on the driver."""
    from lodgecast.plans import numbering

    df = stored(spark.range(2000).select(F.when(F.col("id") % 5 > 0, F.col("id") % 300).alias("g"), "id"))
    by_id = Window.partitionBy("g").orderBy("id")
    expected = sorted(map(repr, df.select("g", "id", F.row_number().over(by_id).alias("position")).collect()))
    for bound, broadcast in ((20_000, True), (50, False)):
        monkeypatch.setattr(numbering, "BROADCAST_ROWS", bound, raising=False)
        numbered = number_rows(df, [F.col("id").asc()], within=["g"])
        assert sorted(map(repr, numbered.select("g", "id", "position").collect())) == expected
        plan = numbered._jdf.queryExecution().executedPlan().toString()
        assert ("Broadcast" in plan) == broadcast
