"""Ranking by risk and the rules that mark high-risk bookings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodgecast.functions import scoring as S
from lodgecast.plans.numbering import number_rows
from lodgecast.plans.selection import text_at
from lodgecast.plans.storage import stored
from lodgecast.schemas import HIGH_RISK_THRESHOLD, ID, POSITION, RISK_SHARE, SCORE_COLUMNS

PROBABILITY = "probability_of_cancellation"


def _by_risk() -> list[Column]:
    # Equal rounded probabilities are ordered by id, missing ids first.
    return [F.col(PROBABILITY).desc(), F.col(ID).asc_nulls_first()]


def round_probability(df: DataFrame, digits: int = 4) -> DataFrame:
    """Probabilities to four decimals, half to even."""
    return df.withColumn(PROBABILITY, S.round_half_even(F.col(PROBABILITY), digits))


def rank_by_risk(df: DataFrame) -> DataFrame:
    """Position 1..n by descending (rounded) probability, plus ``total_rows``.

    Ranks are positions: no two rows share one.
    """
    return number_rows(df, _by_risk(), position="rank", group_rows="total_rows")


def risk_percentile(ranked: DataFrame) -> DataFrame:
    """rank / rows x 100 to two decimals."""
    return ranked.withColumn(
        "risk_percentile", S.percentile_of(F.col("rank"), F.col("total_rows"))
    )


def flag_top_share(ranked: DataFrame, share: float | Column = RISK_SHARE) -> DataFrame:
    """Mark the first ``high_risk_count`` ranks and name their segment."""
    top = S.high_risk_count(F.col("total_rows"), share)
    flagged = ranked.withColumn("is_high_risk", (F.col("rank") <= top).cast("int"))
    return flagged.withColumn("risk_segment", S.top_share_segment(F.col("is_high_risk")))


def build_scoring_table(df: DataFrame, share: float = RISK_SHARE, keep: list[str] = ()) -> DataFrame:
    """Score table of (booking_id, probability) rows; ``keep`` carries further columns along."""
    narrow = round_probability(df.select(ID, PROBABILITY, *keep))
    table = flag_top_share(risk_percentile(rank_by_risk(narrow)), share)
    return table.select(*SCORE_COLUMNS, *keep)


def flag_riskiest(df: DataFrame, share: float = RISK_SHARE, keep: list[str] = ()) -> DataFrame:
    """Flags and segments as in :func:`build_scoring_table`, without ranking the rows.

    Rounded probabilities have few values, so one count of them gives the probability of the
    last flagged rank; among rows of that probability an id cuts them off. Rows are then judged
    one by one.
    """
    rounded = stored(round_probability(df.select(ID, PROBABILITY, *keep)), "probabilities")
    flag = _top_flag(rounded, share)
    if flag is None:  # equal ids lie on the cut: only their places tell them apart
        return build_scoring_table(rounded, share, keep).drop("rank", "risk_percentile")
    flagged = rounded.withColumn("is_high_risk", flag.cast("int"))
    return flagged.withColumn("risk_segment", S.top_share_segment(F.col("is_high_risk"))).select(
        ID, PROBABILITY, "is_high_risk", "risk_segment", *keep
    )


def _top_flag(rounded: DataFrame, share: float) -> Column | None:
    """Whether a row is among the first ranks; None if ids cannot tell."""
    values = rounded.groupBy(PROBABILITY).agg(F.count(F.lit(1)).alias("rows"))
    # At most 10,001 rounded probabilities reach this window.
    down = Window.orderBy(F.col(PROBABILITY).desc_nulls_last())
    placed = values.select(
        PROBABILITY,
        "rows",
        F.sum("rows").over(down.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("rows").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"),
    ).withColumn("top", S.high_risk_count(F.col("all"), share))
    cut = placed.filter((F.col("upto") >= F.col("top")) & (F.col("upto") - F.col("rows") < F.col("top"))).first()
    if cut is None:
        return F.lit(False)  # no rows
    at = F.col(PROBABILITY).eqNullSafe(F.lit(cut[PROBABILITY]))
    above = F.col(PROBABILITY) > F.lit(cut[PROBABILITY])
    if cut[PROBABILITY] is None:
        above = F.col(PROBABILITY).isNotNull()
    above = F.coalesce(above, F.lit(False))
    wanted = cut["top"] - (cut["upto"] - cut["rows"])
    if wanted == cut["rows"]:
        return above | at
    ties = rounded.filter(at).select(F.col(ID).cast("string").alias(ID))
    last = text_at(ties, ID, wanted - 1)
    within = F.col(ID).isNull() if last is None else F.col(ID).isNull() | (F.col(ID) <= F.lit(last))
    if ties.filter(within).count() != wanted:
        return None
    return above | (at & within)


def high_risk_table(df: DataFrame, share: float = RISK_SHARE) -> DataFrame:
    """The flagged rows of :func:`build_scoring_table`; only they are ranked."""
    total = df.count()
    flagged = flag_riskiest(df, share).filter(F.col("is_high_risk") == 1)
    ranked = rank_by_risk(flagged).withColumn("total_rows", F.lit(total))
    return risk_percentile(ranked).select(*SCORE_COLUMNS)


def result_totals(df: DataFrame, share: float = RISK_SHARE) -> DataFrame:
    """Rows, and how many of them are flagged, without ranking any."""
    rows = df.agg(F.count(F.lit(1)).alias("total_bookings"))
    some = F.col("total_bookings") > 0
    top = F.when(some, S.high_risk_count(F.col("total_bookings"), share)).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("high_risk_count", top)


def riskiest(df: DataFrame, k: int = 5, share: float = RISK_SHARE) -> DataFrame:
    """The first ``k`` rows of :func:`build_scoring_table`, found without ranking the others."""
    rounded = round_probability(df.select(ID, PROBABILITY))
    first = rounded.orderBy(*_by_risk()).limit(k)
    few = first.withColumn("rank", F.row_number().over(Window.orderBy(*_by_risk())).cast("long"))
    table = risk_percentile(few.withColumn("total_rows", F.lit(df.count())))
    return flag_top_share(table, share).select(*SCORE_COLUMNS)


def assign_missing_ids(df: DataFrame, order_col: str = POSITION) -> DataFrame:
    """Ids 1..n along ``order_col`` if the id column is absent; otherwise unchanged.

    ``order_col`` stands for the input order. Apply after rows without a date were dropped.
    """
    if ID in df.columns:
        return df
    return number_rows(df, [F.col(order_col).asc()], position=ID).drop("group_rows")


def flag_by_threshold(df: DataFrame, threshold: float = HIGH_RISK_THRESHOLD) -> DataFrame:
    """Judge each row alone: the unrounded probability decides, the rounded one is shown."""
    flagged = df.withColumn("is_high_risk", S.exceeds(F.col(PROBABILITY), threshold))
    return round_probability(
        flagged.withColumn("risk_segment", S.threshold_segment(F.col("is_high_risk")))
    )


def score_requests(df: DataFrame) -> DataFrame:
    """Rank each request's bookings on their own, with the request's ``risk_share``.

    A request is one ``document_id`` if the column is there, else one ``request_id``: documents
    of equal content or equal client ids are still requests of their own.
    """
    request = "document_id" if "document_id" in df.columns else "request_id"
    names = list(dict.fromkeys([request, "request_id"]))
    narrow = round_probability(df.select(*names, "risk_share", ID, PROBABILITY))
    ranked = number_rows(
        narrow, _by_risk(), within=[request], position="rank", group_rows="total_rows"
    )
    table = flag_top_share(risk_percentile(ranked), F.col("risk_share"))
    return table.select(*names, *SCORE_COLUMNS)


def filter_high_risk(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("is_high_risk") == 1)


def batch_result_counts(scores: DataFrame) -> DataFrame:
    """Rows and flagged rows."""
    return scores.agg(
        F.count(F.lit(1)).alias("total_bookings"),
        F.count_if(F.col("is_high_risk") == 1).alias("high_risk_count"),
    )


def top_risk_preview(scores: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` ranks."""
    return scores.orderBy("rank").limit(k)


def standard_output(scores: DataFrame) -> DataFrame:
    return scores.select(ID, PROBABILITY, "rank")


def scores_as_json(scores: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """One JSON record per score; the response shape has four fields."""
    fields = fields or [ID, PROBABILITY, "is_high_risk", "risk_segment"]
    return scores.select(
        *[c for c in ("request_id", "rank") if c in scores.columns],
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"),
    )
