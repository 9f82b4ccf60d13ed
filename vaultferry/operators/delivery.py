"""Delivery receipts: classification, attempts, retries and failure share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultferry.functions.http_status import status_name

TRANSIENT_CODES = (429, 503)
TRANSIENT_EXCEPTIONS = ("HttpRequestException", "TaskCanceledException", "BrokenCircuitException")
RETRIED_EXCEPTION = "HttpRequestException"
MAX_RETRIES = 5
BASE_DELAY_SECONDS = 0.5


def ingest_status(http_status: Column, already_present: Column, exception: Column) -> Column:
    """Ingested, AlreadyPresent, TransientError, PermanentError, or UnexpectedError."""
    return (
        F.when(exception.isin(*TRANSIENT_EXCEPTIONS), "TransientError")
        .when(exception.isNotNull(), "UnexpectedError")
        .when(
            http_status.between(200, 299),
            F.when(F.coalesce(already_present, F.lit(False)), "AlreadyPresent").otherwise(
                "Ingested"
            ),
        )
        .when(http_status.isin(*TRANSIENT_CODES), "TransientError")
        .when(http_status.isNotNull(), "PermanentError")
    )


def error_code(http_status: Column, exception: Column) -> Column:
    """Exception type or status name of a failed delivery, null for a success."""
    return F.when(exception.isNotNull(), exception).when(
        ~http_status.between(200, 299), status_name(http_status)
    )


def classify_receipts(receipts: DataFrame) -> DataFrame:
    """Add ingest_status and error_code; target_id and retry_after only where they apply."""
    status = ingest_status(F.col("http_status"), F.col("already_present"), F.col("exception"))
    return receipts.withColumns(
        {
            "ingest_status": status,
            "error_code": error_code(F.col("http_status"), F.col("exception")),
        }
    ).withColumns(
        {
            "target_id": F.when(
                F.col("ingest_status").isin("Ingested", "AlreadyPresent"), F.col("target_id")
            ),
            "retry_after": F.when(
                (F.col("ingest_status") == "TransientError") & F.col("exception").isNull(),
                F.col("retry_after"),
            ),
        }
    )


def is_retryable(http_status: Column, exception: Column) -> Column:
    return F.coalesce(
        http_status.isin(*TRANSIENT_CODES) | (exception == RETRIED_EXCEPTION),
        http_status.isin(*TRANSIENT_CODES),
        exception == RETRIED_EXCEPTION,
        F.lit(False),
    )


def attempt_rollup(
    attempts: DataFrame, order: list[str] | None = None, max_retries: int = MAX_RETRIES
) -> DataFrame:
    """Last attempt per key with the number of attempts used.

    A maximum by attempt order combines before the shuffle; no window over a key's attempts.
    """
    rank = F.struct(*(order or ["attempt_no"]))
    fields = [
        c
        for c in ("http_status", "exception", "already_present", "target_id", "retry_after", "at_utc")
        if c in attempts.columns
    ]
    last = (
        attempts.groupBy("idempotency_key")
        .agg(F.max_by(F.struct(*fields), rank).alias("_last"), F.count(F.lit(1)).alias("attempts"))
        .select("idempotency_key", "attempts", "_last.*")
    )
    for name, kind in (
        ("already_present", "boolean"),
        ("target_id", "string"),
        ("retry_after", "double"),
        ("exception", "string"),
    ):
        if name not in fields:
            last = last.withColumn(name, F.lit(None).cast(kind))
    retryable = is_retryable(F.col("http_status"), F.col("exception"))
    return classify_receipts(last).withColumns(
        {
            "retryable": retryable,
            "exhausted": retryable & (F.col("attempts") > F.lit(max_retries)),
        }
    )


def retry_queue(
    rollup: DataFrame,
    base_delay_seconds: float = BASE_DELAY_SECONDS,
) -> DataFrame:
    """Keys to try again and when: the delay the target asked for, else doubling steps."""
    backoff = F.lit(base_delay_seconds) * F.pow(F.lit(2.0), F.col("attempts") - 1)
    delay = F.coalesce(F.col("retry_after"), backoff)
    return (
        rollup.where(F.col("retryable") & ~F.col("exhausted"))
        .withColumn("delay_seconds", delay)
        .withColumn(
            "due_at_utc",
            F.col("at_utc")
            + F.make_dt_interval(secs=F.col("delay_seconds").cast("decimal(18,6)")),
        )
    )


def is_breaker_failure(http_status: Column, exception: Column) -> Column:
    """Failures that count against the target: 5xx, 408, 429 and connection errors."""
    return F.coalesce(
        exception.isin("HttpRequestException", "TimeoutRejectedException")
        | (F.coalesce(http_status, F.lit(0)) >= 500)
        | F.coalesce(http_status.isin(408, 429), F.lit(False)),
        (F.coalesce(http_status, F.lit(0)) >= 500)
        | F.coalesce(http_status.isin(408, 429), F.lit(False)),
    )


def failure_ratio(
    attempts: DataFrame, seconds: int = 30, threshold: float = 0.5
) -> DataFrame:
    """Share of failed deliveries per tumbling window; works on batch and stream."""
    failed = is_breaker_failure(F.col("http_status"), F.col("exception"))
    windowed = attempts.groupBy(F.window("at_utc", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("deliveries"), F.count_if(failed).alias("failures")
    )
    ratio = F.col("failures") / F.col("deliveries")
    return windowed.select(
        F.col("w.start").alias("window_start"),
        "deliveries",
        "failures",
        ratio.alias("failure_ratio"),
        (ratio >= threshold).alias("tripped"),
    )


def sliding_failure_share(
    attempts: DataFrame, seconds: int = 30, threshold: float = 0.5, least: int = 1
) -> DataFrame:
    """Share of failed deliveries in the ``seconds`` up to each moment with an attempt.

    The span is open at its start and closed at the moment itself; ``tripped`` needs ``least``
    deliveries in it. Attempts without a time are in no span. Time is cut into cells as long as
    the span: a moment counts in its own cell, is carried into the next, and leaves there when
    the span has passed. So a running sum within each cell is enough: no frame is summed again for
    each row, and the cells are spread over all tasks; a task holds the distinct moments of two
    spans at most.
    """
    span = seconds * 1_000_000
    failed = is_breaker_failure(F.col("http_status"), F.col("exception"))
    moments = (
        attempts.where(F.col("at_utc").isNotNull())
        .groupBy("at_utc")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("bad"))
        .withColumn("at", F.unix_micros("at_utc"))
        .withColumn("cell", F.col("at") - F.pmod("at", F.lit(span)))
    )

    def step(cell: Column, at: Column, sign: int, own: bool) -> Column:
        return F.struct(
            cell.alias("cell"), at.alias("at"), F.lit(sign).alias("sign"), F.lit(own).alias("own")
        )

    following = F.col("cell") + span
    steps = F.array(
        step(F.col("cell"), F.col("at"), 1, True),
        step(following, following - 1, 1, False),
        step(following, F.col("at") + span, -1, False),
    )
    moved = moments.select("at_utc", "n", "bad", F.explode(steps).alias("s"))
    so_far = (
        Window.partitionBy("s.cell")
        .orderBy("s.at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = moved.select(
        "at_utc",
        F.col("s.own").alias("own"),
        F.sum(F.col("n") * F.col("s.sign")).over(so_far).alias("deliveries"),
        F.sum(F.col("bad") * F.col("s.sign")).over(so_far).alias("failures"),
    ).where("own")
    share = F.col("failures") / F.col("deliveries")
    return summed.select(
        "at_utc",
        "deliveries",
        "failures",
        share.alias("failure_share"),
        ((share >= threshold) & (F.col("deliveries") >= least)).alias("tripped"),
    )
