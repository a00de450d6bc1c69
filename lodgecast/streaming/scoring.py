"""Online scoring as streams of JSON request files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodgecast.functions.dates import with_date
from lodgecast.operators.analysis import sketched_drift
from lodgecast.operators.clean import (
    booking_features,
    impute,
    parse_reservation_date,
    plain_counts,
)
from lodgecast.operators.monitor import batch_metrics
from lodgecast.operators.rank import flag_by_threshold, score_requests
from lodgecast.operators.validate import drop_invalid_dates, validate_bookings, validate_requests
from lodgecast.plans.sketches import keep_sketches, sketch_columns
from lodgecast.plans.storage import stored
from lodgecast.schemas import DATE, HIGH_RISK_THRESHOLD
from lodgecast.session import scratch_scope
from lodgecast.sinks.tables import append_monitoring
from lodgecast.sources.requests import identify_documents, request_documents, split_documents

Scorer = Callable[[DataFrame], DataFrame]  # adds probability_of_cancellation

UNREAD_DATE = f"{DATE}: Input should be a valid date"


def request_stream(
    spark: SparkSession, path: str, files_per_batch: int = 100, multiline: bool = False
) -> DataFrame:
    """New JSON request files below ``path``, one row per request document."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    return request_documents(reader, path, multiline)


def _bookings(
    documents: DataFrame, batch_id: int, stats: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """(bookings, rejected documents) of a batch; the numbers of documents hold in the batch."""
    identified = identify_documents(documents, f"{batch_id}:")
    bookings, rejected = split_documents(identified)
    return (bookings if stats is None else impute(bookings, stats)), rejected


def _features(bookings: DataFrame) -> DataFrame:
    return booking_features(drop_invalid_dates(parse_reservation_date(bookings)))


def _write_rejected(
    documents: DataFrame, invalid: DataFrame, valid: DataFrame, rejected: str | None, batch_id: int
) -> None:
    """Everything a batch did not score, with the reasons."""
    if rejected is None:
        return
    undated = with_date(valid, DATE, "_date").filter("_date IS NULL")
    undated = undated.withColumn("errors", F.array(F.lit(UNREAD_DATE)))
    names = documents.columns
    rows = documents.unionByName(invalid.select(*names)).unionByName(undated.select(*names))
    rows.write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}")


def stream_score_single(
    requests: DataFrame,
    scorer: Scorer,
    output: str,
    checkpoint: str,
    stats: DataFrame | None = None,
    threshold: float = HIGH_RISK_THRESHOLD,
    rejected: str | None = None,
) -> StreamingQuery:
    """Judge each valid booking of the stream alone and write it to Parquet files.

    A booking that lacks a required cell is invalid, unless stored ``stats`` are given to fill it
    from; a stream has no statistics of its own. Documents and bookings that are not scored go to
    ``rejected`` with the reasons. Each batch replaces its own partition ``batch_id`` of both
    outputs, so a batch repeated after a failure leaves no second copy.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):  # a long-running stream must not pile up files
            bookings, documents = _bookings(batch, batch_id, stats)
            valid, invalid = validate_bookings(bookings)
            scored = flag_by_threshold(scorer(_features(valid)), threshold).select(
                "document_id", "request_id", "booking_id", "probability_of_cancellation",
                "is_high_risk", "risk_segment",
            )
            scored.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")
            _write_rejected(documents, invalid, valid, rejected, batch_id)

    return _start(requests, one_batch, checkpoint)


def stream_score_requests(
    requests: DataFrame,
    scorer: Scorer,
    output: str,
    checkpoint: str,
    stats: DataFrame | None = None,
    metrics_table: str | None = None,
    model_name: str = "GBT",
    rejected: str | None = None,
    stream_name: str | None = None,
) -> StreamingQuery:
    """Rank every request of the stream on its own; optionally append batch metrics.

    A request is one JSON document and so always lies within one batch. Documents, requests and
    bookings that are not scored go to ``rejected`` with the reasons. Each batch replaces its own
    partition ``batch_id``. Metrics are kept under ``stream_name`` (the id of the stream's
    checkpoint if not given, which survives restarts and is never shared) and the batch.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        with scratch_scope(session):
            bookings, documents = _bookings(batch, batch_id, stats)
            valid, invalid = validate_requests(bookings)
            valid = stored(valid, "requests")
            scores = stored(score_requests(scorer(_features(valid))), "request-scores")
            scores.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")
            _write_rejected(documents, invalid, valid, rejected, batch_id)
            if metrics_table is not None:
                name = stream_name or session.sparkContext.getLocalProperty("sql.streaming.queryId")
                append_monitoring(
                    batch_metrics(plain_counts(valid), scores),
                    metrics_table,
                    "stream_predict",
                    model_name,
                    f"{name}-{batch_id}",
                )

    return _start(requests, one_batch, checkpoint)


def stream_feature_drift(
    requests: DataFrame,
    reference: DataFrame,
    numeric: Sequence[str],
    output: str,
    checkpoint: str,
    stats: DataFrame | None = None,
) -> StreamingQuery:
    """Drift of each batch's valid bookings against a kept reference.

    ``reference`` has one sketch per feature (see ``plans.sketches``); its rows are not needed.
    ``output/sketches`` keeps each batch's own sketches, which merge into those of any stretch of
    the stream, and ``output/drift`` its index per feature. Each batch replaces its own partitions.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(batch.sparkSession):
            bookings, _ = _bookings(batch, batch_id, stats)
            sketches = stored(sketch_columns(_features(validate_bookings(bookings)[0]), numeric), "sketches")
            keep_sketches(sketches, f"{output}/sketches", str(batch_id))
            drift = sketched_drift(reference, sketches).join(sketches.select("feature", "rows"), "feature")
            drift.write.mode("overwrite").parquet(f"{output}/drift/batch_id={batch_id}")

    return _start(requests, one_batch, checkpoint)


def _start(requests: DataFrame, one_batch: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        requests.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
