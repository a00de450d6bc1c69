"""Scoring requests from JSON documents ``{request_id?, bookings: [...], risk_share?}``.

A document is told apart by the file it came in and its place there, never by its content or by
the id the client gave it. Documents that cannot be read are handed back with the reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodgecast.plans.storage import stored
from lodgecast.schemas import COUNT_COLUMNS, LABEL, PRICE, RISK_SHARE, WIRE_TO_CANONICAL

REJECTED = "document_id string, request_id string, booking_id string, errors array<string>"

# Rejection messages.
NO_JSON = "document: Invalid JSON"
NO_OBJECT = "document: Input should be an object"
NO_BOOKINGS = "bookings: Field required"
NO_LIST = "bookings: Input should be a valid list"
EMPTY_LIST = "bookings: List should have at least 1 item"
NO_TEXT = "Input should be a valid string"

_FIELDS = {wire: name for wire, name in WIRE_TO_CANONICAL.items() if name != LABEL}
_TEXTS = [n for n in _FIELDS.values() if n not in COUNT_COLUMNS and n != PRICE]


def request_documents(reader, path: str, multiline: bool = False) -> DataFrame:
    """``document, file`` from a batch or stream reader.

    One document per line; with ``multiline`` one per file, over any number of lines. Blank
    lines are no documents. Read line by line, a document over several lines is as many broken
    documents, which are rejected and not lost.
    """
    text = reader.text(path, wholetext=multiline)
    return text.select(F.col("value").alias("document"), F.col("_metadata.file_path").alias("file")).filter(
        F.trim(F.regexp_replace("document", r"\s+", " ")) != ""
    )


def identify_documents(documents: DataFrame, prefix: str = "") -> DataFrame:
    """Add ``document_id``: the file and a number given once, when the frame is written."""
    number = F.monotonically_increasing_id().cast("string")
    place = F.concat(F.lit(prefix), F.element_at(F.split("file", "/"), -1), F.lit("#"), number)
    return stored(documents.withColumn("document_id", place), "documents")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def split_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bookings, rejected) of identified documents.

    Bookings: one row per booking, typed and in canonical names, with ``document_id``,
    ``request_id`` (the client's, may be null or shared), ``risk_share`` (the default if absent,
    null if unreadable), ``position`` and ``type_errors``. Rejected: documents that are no JSON
    object, or whose list of bookings is missing, no list, or empty.
    """
    parsed = documents.withColumn("_json", F.try_parse_json("document"))
    part = lambda path: F.try_variant_get("_json", path, "variant")
    parsed = parsed.withColumns(
        {
            "_object": F.coalesce(_kind(F.col("_json")).startswith("OBJECT"), F.lit(False)),
            "_list": _kind(part("$.bookings")),
            "_share": _kind(part("$.risk_share")),
            "request_id": F.try_variant_get("_json", "$.request_id", "string"),
        }
    ).withColumn("_bookings", F.try_variant_get("_json", "$.bookings", "array<variant>"))
    reason = (
        F.when(F.col("_json").isNull(), NO_JSON)
        .when(~F.col("_object"), NO_OBJECT)
        .when(F.col("_list").isNull(), NO_BOOKINGS)
        .when(~F.col("_list").startswith("ARRAY"), NO_LIST)
        .when(F.size("_bookings") == 0, EMPTY_LIST)
    )
    parsed = parsed.withColumn("_reason", reason)
    rejected = parsed.filter(F.col("_reason").isNotNull()).select(
        "document_id",
        "request_id",
        F.lit(None).cast("string").alias("booking_id"),
        F.array("_reason").alias("errors"),
    )
    given = F.try_variant_get("_json", "$.risk_share", "double")
    exploded = parsed.filter(F.col("_reason").isNull()).select(
        "document_id",
        "request_id",
        F.when(F.col("_share").isNull(), F.lit(RISK_SHARE)).otherwise(given).alias("risk_share"),
        F.posexplode("_bookings").alias("position", "_booking"),
    )
    wrong = [F.when(_is_wrong(name), F.lit(f"{name}: {NO_TEXT}")) for name in _TEXTS]
    bookings = exploded.select(
        "document_id",
        "request_id",
        "risk_share",
        "position",
        *[_field(name).alias(name) for name in _FIELDS.values()],
        F.array_compact(F.array(*wrong)).alias("type_errors"),
    )
    return bookings, rejected


def _get(name: str, kind: str) -> Column:
    """A field by its wire name, else by its canonical one."""
    wire = next(w for w, n in _FIELDS.items() if n == name)
    return F.coalesce(
        *[F.try_variant_get("_booking", f"$['{key}']", kind) for key in dict.fromkeys((wire, name))]
    )


def _is_wrong(name: str) -> Column:
    """A text field that holds something else; absent and null cells are no matter of type."""
    return ~F.coalesce(_kind(_get(name, "variant")), F.lit("VOID")).isin("STRING", "VOID")


def _field(name: str) -> Column:
    text = _get(name, "string")
    if name in COUNT_COLUMNS:
        number = F.trim(text).try_cast("double")
        return F.when(number == F.floor(number), number.try_cast("int"))
    if name == PRICE:
        return F.trim(text).try_cast("double")
    return F.when(~_is_wrong(name), text)


def read_requests(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """(bookings, rejected) of the request files below ``path``."""
    return split_documents(identify_documents(request_documents(spark.read, path, multiline)))


def read_booking_requests(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """The bookings of :func:`read_requests`; use that to see what was rejected."""
    return read_requests(spark, path, multiline)[0]
