"""Splits, training, scoring and saved models."""

from __future__ import annotations

import pytest
from conftest import SMALL, rows
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lodgecast.functions.scoring import row_key, uniform_hash
from lodgecast.operators import analysis as A
from lodgecast.operators import clean as C
from lodgecast.operators import encode as N
from lodgecast.operators import split as P
from lodgecast.operators import train as M
from lodgecast.operators.evaluate import METRICS
from lodgecast.operators.rank import PROBABILITY
from lodgecast.plans import joins
from lodgecast.plans.storage import stored
from lodgecast.schemas import CATEGORY_COLUMNS, LABEL, POSITION
from lodgecast.sinks import artifacts
from lodgecast.sources.orders import bookings_from_orders, labelled_bookings, new_bookings

QUICK = {"maxIter": 3, "maxDepth": 3, "lossType": "logistic"}


@pytest.fixture(scope="module")
def raw(spark):
    return stored(bookings_from_orders(spark, SMALL))


@pytest.fixture(scope="module")
def run(spark, raw):
    return M.train_and_report(labelled_bookings(raw), QUICK)


def test_quotas():
    assert P.class_quotas({0: 60, 1: 40}, 0.2) == {0: 12, 1: 8}
    assert sum(P.class_quotas({0: 7, 1: 4}, 0.2).values()) == 3
    assert P.class_quotas({0: 5, 1: 5, 2: 1}, 0.3) == {0: 2, 1: 2, 2: 0}


@pytest.mark.parametrize("limit", [20, 100_000])
def test_split_is_exact_whole_and_repeatable(spark, limit):
    df = spark.range(0, 997).select(
        F.concat(F.lit("b"), "id").alias("booking_id"), (F.col("id") % 3 == 0).cast("int").alias(LABEL)
    )
    first = P.split_stratified(df, limit=limit)
    counts = {(r[LABEL], r["split"]): r["count"] for r in first.groupBy(LABEL, "split").count().collect()}
    held = P.class_quotas({0: 664, 1: 333}, 0.2)
    assert counts[0, "test"] == held[0] and counts[1, "test"] == held[1]
    assert sum(counts.values()) == 997
    again = P.split_stratified(df.repartition(5), limit=limit)
    assert rows(first, "booking_id", "split") == rows(again, "booking_id", "split")
    other = P.split_stratified(df, seed=7)
    assert rows(first, "booking_id", "split") != rows(other, "booking_id", "split")


def test_split_of_rows_without_ids_keeps_the_quota(spark):
    df = spark.range(0, 500).select(
        F.lit(None).cast("string").alias("booking_id"), "id", (F.col("id") % 2).cast("int").alias(LABEL)
    )
    assert P.split_stratified(df).filter("split = 'test'").count() == 100


def test_split_plan_moves_no_rows(spark):
    df = stored(spark.range(0, 500).select(F.col("id").cast("string").alias("booking_id"), (F.col("id") % 2).cast("int").alias(LABEL)))
    plan = P.split_stratified(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def test_split_refuses_missing_labels(spark):
    df = spark.createDataFrame([("a", None)], f"booking_id string, {LABEL} int")
    with pytest.raises(ValueError):
        P.split_stratified(df)


def test_three_way_split(spark):
    df = spark.range(0, 1000).select(F.col("id").cast("string").alias("booking_id"), (F.col("id") % 2).cast("int").alias(LABEL))
    counts = {r["split"]: r["count"] for r in P.split_three_way(df).groupBy("split").count().collect()}
    assert counts == {"test": 200, "validation": 160, "train": 640}


def test_report(run):
    report = run.report
    assert set(report) == {
        "split", "preprocessing", "categorical_columns", "parameters", "metrics", "best_model",
    }
    assert sorted(report["categorical_columns"]) == sorted(CATEGORY_COLUMNS)
    after = report["preprocessing"]["processed_shape"]
    assert report["split"]["train_rows"] + report["split"]["test_rows"] == after[0] and after[1] == 26
    metrics = run.metrics.first().asDict()
    assert list(metrics) == METRICS and all(0.0 <= v <= 1.0 for v in metrics.values())
    assert run.version.startswith("gbt_") and run.version.endswith("Z")


def test_saved_model_scores_alike(spark, raw, run, tmp_path):
    artifacts.save_training_run(spark, run, str(tmp_path))
    model, categories, name = artifacts.load_model(spark, str(tmp_path))
    assert name == "GBT" and sorted(categories) == sorted(CATEGORY_COLUMNS)
    new = new_bookings(raw)
    before = M.score_batch(new, run.model).scores
    after = M.score_batch(new, model).scores
    assert rows(before, *before.columns) == rows(after, *after.columns)


def test_batch_scores_keep_the_contract(raw, run):
    result = M.score_batch(new_bookings(raw), run.model, share=0.3)
    found = result.scores.collect()
    n = len(found)
    assert n == result.cleaned.summary.first()["records_after"]
    assert sorted(r["rank"] for r in found) == list(range(1, n + 1))
    assert sum(r["is_high_risk"] for r in found) == -(-n * 3 // 10)
    assert all(0 <= r["probability_of_cancellation"] <= 1 for r in found)


def test_bookings_without_ids_are_scored(spark, raw, run):
    new = new_bookings(raw).withColumn(POSITION, F.monotonically_increasing_id()).drop("booking_id")
    scores = M.score_batch(new, run.model).scores
    assert sorted(r[0] for r in scores.select("booking_id").collect()) == list(range(1, scores.count() + 1))


def test_unseen_categories_are_scored(raw, run):
    odd = new_bookings(raw).withColumn("room_type", F.lit("Igloo"))
    assert M.score_single_rule(odd, run.model).filter("probability_of_cancellation IS NULL").count() == 0


def _wide(spark, values: int, copies: int = 4):
    """A column of ``values`` values of which every other one always cancels, beside noise."""
    return spark.range(0, values * copies).select(
        F.format_string("B%07d", "id").alias("booking_id"),
        F.format_string("room %06d", F.col("id") % values).alias("room_type"),
        (F.xxhash64("id") % 100).cast("double").alias("lead_time"),
        (F.col("id") % values % 2).cast("int").alias(LABEL),
    )


def test_wide_columns_are_numbered_without_loss(spark, monkeypatch):
    for bound in (100_000, 50):  # broadcast, then salted
        monkeypatch.setattr(joins.lookup_join, "__defaults__", ("inner", bound, 4, None))
        train = stored(_wide(spark, 300, 2))
        test = train.limit(20).unionByName(train.limit(3).withColumn("room_type", F.lit("room new"))).unionByName(
            train.limit(2).withColumn("room_type", F.lit(None).cast("string"))
        )
        coded, tested = M.encode_categories(train, test)
        assert coded.columns == [*train.columns, "room_type_index"]
        found = {(r["room_type"], r["room_type_index"]) for r in coded.collect()}
        assert found == {(f"room {k:06d}", float(k)) for k in range(300)}
        last = [r["room_type_index"] for r in tested.collect() if r["room_type"] in (None, "room new")]
        assert last == [300.0] * 5 and tested.count() == 25


def test_label_rates_leave_the_own_fold_out(spark):
    data = [(f"b{i}", ["x", "y", None][i % 3] if i % 11 else f"rare {i}", i % 2) for i in range(200)]
    train = stored(spark.createDataFrame(data, f"booking_id string, room_type string, {LABEL} int"))
    rates, others = N.fit_label_rates(train, ["room_type"], folds=3, smoothing=2.0)
    marked = train.select("booking_id", F.pmod(uniform_hash(row_key(train), "42-fold"), F.lit(3)).alias("fold"))
    fold = {r["booking_id"]: r["fold"] for r in marked.collect()}
    found = {r["booking_id"]: (r["room_type_rate"], r["room_type_share"]) for r in others.collect()}
    assert len(found) == 200

    def by_hand(value, rows):
        prior = sum(r[2] for r in rows) / len(rows)
        same = [r[2] for r in rows if value is not None and r[1] == value]
        return (sum(same) + 2 * prior) / (len(same) + 2), len(same) / len(rows)

    for booking_id, value, _ in data:
        rest = [r for r in data if fold[r[0]] != fold[booking_id]]
        assert found[booking_id] == pytest.approx(by_hand(value, rest))
    seen = {r["room_type"]: (r[1], r[2]) for r in rates.transform(
        spark.createDataFrame([("x",), ("never",), (None,)], "room_type string")).collect()}
    assert all(seen[v] == pytest.approx(by_hand(v, data)) for v in ("x", "never", None))
    nothing, same = N.fit_label_rates(train, [])
    assert nothing.outputs == [] and same.columns == train.columns


def test_a_wide_column_keeps_its_effect(spark, tmp_path):
    """20,000 values, each a third of the time in the test rows: they decide every prediction."""
    rows = _wide(spark, 20_000).withColumn("split", F.when(F.col("booking_id") < "B0060000", "train").otherwise("test"))
    parts = stored(rows)
    train, test = (parts.filter(F.col("split") == s).drop("split") for s in ("train", "test"))
    model = M.train_model(train, {"maxIter": 3, "maxDepth": 2})
    assert M.evaluate_model(model, test).first()["roc_auc"] > 0.99
    model.save(str(tmp_path))
    again = M.BookingModel.load(spark, str(tmp_path))
    few = test.limit(50)
    assert rows_of(M.predict_proba(again, few)) == rows_of(M.predict_proba(model, few))


def rows_of(df):
    return rows(df, *df.columns)


@pytest.fixture(scope="module")
def vectors(spark):
    """Vectors whose label follows two numbers, with noise: some dozen trees pay."""
    noise = F.xxhash64("id") % 100 / 100
    frame = spark.range(0, 1500).select(
        F.format_string("B%05d", "id").alias("booking_id"),
        (F.col("id") % 37).cast("double").alias("lead_time"),
        (F.col("id") % 11).cast("double").alias("average_price"),
        ((F.sin(F.col("id") % 37) + F.col("id") % 11 / 5 + noise) > 1.2).cast("int").alias(LABEL),
    )
    return M.assemble(stored(frame))


def test_fewer_rounds_have_the_same_first_trees(vectors):
    params = {"maxIter": 6, "maxDepth": 3, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85"}
    long, short = (
        vectors.fit(M.boosted_trees({**params, "maxIter": n}), held_out=True).classifier for n in (6, 3)
    )
    assert [t.toDebugString.split("\n", 1)[1] for t in long.trees[:3]] == [t.toDebugString.split("\n", 1)[1] for t in short.trees]


def test_boosting_ends_by_itself_and_goes_on_where_it_was_stopped(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "FIRST_ROUNDS", 4)
    params, path = {"maxIter": 16, "maxDepth": 3, "stepSize": 0.2}, str(tmp_path / "turns")
    fits = []
    whole = M.Assembled.fit
    monkeypatch.setattr(M.Assembled, "fit", lambda self, c, held_out=False: fits.append(c.getMaxIter()) or whole(self, c, held_out))
    model = M.fit_until_settled(vectors, params, progress=path)
    turns = {r["rounds"]: r for r in spark.read.parquet(path).collect()}
    errors = whole(vectors, M.boosted_trees(params), True).classifier.evaluateEachIteration(vectors.frame.filter("_validation"))
    for rounds, turn in turns.items():
        assert turn["error"] == pytest.approx(min(errors[:rounds])) and errors[turn["best"] - 1] == pytest.approx(turn["error"])
    last = max(turns)
    assert 2 * turns[last]["best"] <= last or last == 16
    assert all(2 * turns[r]["best"] > r for r in turns if r < last)
    assert model.classifier.getNumTrees == turns[last]["best"]
    # Stopped after its last turn, it only makes the model.
    del fits[:]
    again = M.fit_until_settled(vectors, params, progress=path)
    assert fits == [turns[last]["best"]] and again.classifier.getNumTrees == model.classifier.getNumTrees
    assert spark.read.parquet(path).count() == len(turns)


def test_a_search_goes_on_where_it_was_stopped(spark, raw, tmp_path, monkeypatch):
    train = stored(C.preprocess_bookings(labelled_bookings(raw)).frame)
    path, base = str(tmp_path / "search"), {"maxIter": 2, "maxDepth": 2}
    grid = {"stepSize": [0.1, 0.3]}
    first, _ = M.cross_validate(train, grid, folds=2, base=base, progress=path)
    assert spark.read.parquet(path).count() == 4
    fits = []
    whole = M.fit_until_settled
    monkeypatch.setattr(M, "fit_until_settled", lambda *a, **b: fits.append(a[1]) or whole(*a, **b))
    again, model = M.cross_validate(train, {"stepSize": [0.1, 0.3, 0.5]}, folds=2, base=base, progress=path)
    assert [f["stepSize"] for f in fits[:-1]] == [0.5, 0.5]  # the last fit is the chosen model
    found = {r["settings"]: r for r in again.collect()}
    assert all(found[r["settings"]]["mean_roc_auc"] == r["mean_roc_auc"] for r in first.collect())
    assert sum(r["is_best"] for r in found.values()) == 1 and model.classifier.getNumTrees <= 2


def test_the_full_settings(spark, raw):
    """One training run with nothing cut: up to 700 trees of depth 8."""
    run = M.train_and_report(labelled_bookings(raw))
    assert run.report["parameters"]["GBT"] == M.FULL_PARAMS
    assert 1 <= run.model.classifier.getNumTrees <= M.FULL_PARAMS["maxIter"]
    assert run.model.classifier.getOrDefault("maxDepth") == 8


def test_outliers_and_guard(raw):
    frame = stored(C.preprocess_bookings(labelled_bookings(raw)).frame)
    bounds = A.outlier_bounds(frame, ["average_price"])
    low, high = bounds.first()["lower"], bounds.first()["upper"]
    kept = A.drop_outliers(frame, bounds)
    outside = frame.filter((F.col("average_price") < low) | (F.col("average_price") > high)).count()
    assert kept.count() == frame.count() - outside
    guarded = A.leakage_guard(frame.withColumn("checked_out_at", F.lit(1)))
    assert "checked_out_at" not in guarded.columns and LABEL not in guarded.columns


def test_equal_frames_do_not_drift(raw):
    frame = stored(C.preprocess_bookings(labelled_bookings(raw)).frame)
    drift = A.feature_drift(frame, frame, ["lead_time"], ["room_type"]).collect()
    assert {r["feature"]: r["psi"] for r in drift} == {"lead_time": 0.0, "room_type": 0.0}
    moved = frame.withColumn("lead_time", F.col("lead_time") + 200)
    assert A.feature_drift(frame, moved, ["lead_time"]).first()["psi"] > 0.2


def test_a_model_scores_a_stream_as_it_scores_a_batch(spark, raw, run, tmp_path):
    from lodgecast.sources.bookings import rename_bookings
    from lodgecast.streaming import scoring as T

    new = stored(C.impute(new_bookings(raw)))
    wire = rename_bookings(new, "wire")
    document = F.struct(F.array(F.struct(*[F.col(f"`{c}`") for c in wire.columns])).alias("bookings"))
    wire.select(F.to_json(document).alias("value")).coalesce(2).write.text(str(tmp_path / "in"))
    T.stream_score_single(
        T.request_stream(spark, str(tmp_path / "in")),
        lambda df: M.predict_proba(run.model, df),
        str(tmp_path / "out"),
        str(tmp_path / "state"),
        threshold=0.5,
    ).awaitTermination()
    batch = M.score_single_rule(new, run.model, threshold=0.5)
    columns = ["booking_id", "probability_of_cancellation", "is_high_risk", "risk_segment"]
    assert rows(spark.read.parquet(str(tmp_path / "out")), *columns) == rows(batch, *columns)


def test_models_score_in_a_session_that_observed_a_query(spark):
    """Training summaries hold the session, which cannot be sent to tasks after an observation."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    rows = spark.range(200).select(
        F.concat(F.lit("b"), "id").alias("booking_id"),
        (F.col("id") % 2).cast("int").alias("booking_status"),
        (F.col("id") % 7).cast("double").alias("average_price"),
        (F.col("id") % 5).cast("int").alias("total_nights"),
        (F.col("id") % 11).cast("int").alias("lead_time"),
    )
    rows = stored(rows)
    baseline = M.train_baseline_lr(rows)
    assert M.predict_proba(baseline, rows).filter(F.col(PROBABILITY).between(0, 1)).count() == 200
    candidates = {
        "LogisticRegression": LogisticRegression(labelCol=LABEL, maxIter=5),
        "RandomForest": RandomForestClassifier(labelCol=LABEL, numTrees=3, seed=1),
    }
    compared, models = M.compare_models(rows, rows, candidates)
    assert compared.count() == 2 and not any(m.classifier.hasSummary for m in models.values())


def test_the_settled_model_is_taken_from_the_last_turn(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "FIRST_ROUNDS", 4)
    fits, params = [], {"maxIter": 4, "maxDepth": 3, "stepSize": 1.0, "subsamplingRate": 0.85}
    whole = M.Assembled.fit
    monkeypatch.setattr(M.Assembled, "fit", lambda self, c, held_out=False: fits.append(c.getMaxIter()) or whole(self, c, held_out))
    # The smallest error is put at the second tree, whatever the rows.
    monkeypatch.setattr(M.GBTClassificationModel, "evaluateEachIteration", lambda self, df: [3.0, 1.0, 2.0, 2.0])
    model = M.fit_until_settled(vectors, params)
    assert fits == [4] and model.classifier.getNumTrees == 2  # not fitted a second time
    short = whole(vectors, M.boosted_trees({**params, "maxIter": 2}), True)
    model.save(str(tmp_path / "model"))
    loaded = M.BookingModel.load(spark, str(tmp_path / "model"))
    expected = [tuple(r) for r in short.classifier.transform(vectors.frame).select("probability", "prediction").collect()]
    for kept in (model, loaded):
        rows = kept.classifier.transform(vectors.frame).select("probability", "prediction").collect()
        assert [tuple(r) for r in rows] == expected
        assert kept.classifier.getMaxIter() == 2 and kept.classifier.getOrDefault("maxDepth") == 3
        assert kept.classifier.treeWeights == short.classifier.treeWeights
        assert kept.classifier.numFeatures == short.classifier.numFeatures > 0 and kept.classifier.numClasses == 2
        assert kept.classifier.featureImportances.toArray() == pytest.approx(short.classifier.featureImportances.toArray())
