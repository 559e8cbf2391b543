"""Sessions by inactivity, without bringing a user's rows together.

A user's time line is cut into slices as wide as the timeout. Two rows of one
slice are closer than the timeout, so a session can only open at the first row
of a slice. Slices are plain (min, max, count) aggregates, combined on the map
side; only slices are put in order per user, and their number is bounded by
the covered time over the timeout, however many rows a user has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_TIMEOUT = 1800

# slice of rows without timestamp: sorts before every other slice
UNDATED = -(2 ** 63)


def slice_of(ts: Column, timeout: int) -> Column:
    """Start, in epoch microseconds, of the slice a timestamp falls into."""
    width = F.lit(max(timeout * 1_000_000, 1)).cast("bigint")
    micros = F.unix_micros(ts)
    return F.coalesce(micros - F.pmod(micros, width), F.lit(UNDATED).cast("bigint"))


def session_labels(rows: DataFrame, timeout: int = DEFAULT_TIMEOUT, clicked: Column | None = None) -> DataFrame:
    """One row per user and slice with its session.

    Columns: user_id, slice, first_ts, last_ts, n_rows, n_clicks, rows_before
    (rows of the user in earlier slices), session_seq (1 = first by start) and
    session_start. A gap longer than the timeout opens a session; rows without
    timestamp come first, never open one by themselves and leave the session
    they begin without start. A session without start sorts as the epoch.
    """
    clicks = F.lit(0).cast("bigint") if clicked is None else F.count_if(clicked)
    slices = (
        rows.withColumn("slice", slice_of(F.col("timestamp"), timeout))
        .groupBy("user_id", "slice")
        .agg(
            F.min("timestamp").alias("first_ts"),
            F.max("timestamp").alias("last_ts"),
            F.count("*").alias("n_rows"),
            clicks.alias("n_clicks"),
        )
    )
    user = Window.partitionBy("user_id")
    line = user.orderBy("slice")
    so_far = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    gap = F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(line))
    first = F.lag(F.lit(True)).over(line).isNull()
    opened = slices.withColumn("_opens", first | F.coalesce(gap > timeout * 1_000_000, F.lit(False)))
    # the start is wrapped so that a missing start is carried along, not skipped
    start = F.last(F.when(F.col("_opens"), F.struct("first_ts")), ignorenulls=True).over(so_far)
    early = F.col("_opens") & (F.col("first_ts") < F.timestamp_seconds(F.lit(0)))
    numbered = opened.select(
        "user_id", "slice", "first_ts", "last_ts", "n_rows", "n_clicks",
        (F.sum("n_rows").over(so_far) - F.col("n_rows")).alias("rows_before"),
        F.count_if("_opens").over(so_far).alias("_opened"),
        start["first_ts"].alias("session_start"),
        (F.min("slice").over(user) == UNDATED).alias("_undated"),
        F.count_if(early).over(user).alias("_early"),
    )
    # a first session without start moves behind the sessions that start before the epoch
    seq = (
        F.when(~F.col("_undated"), F.col("_opened"))
        .when(F.col("_opened") == 1, F.col("_early") + 1)
        .when(F.col("_opened") <= F.col("_early") + 1, F.col("_opened") - 1)
        .otherwise(F.col("_opened"))
    )
    return numbered.withColumn("session_seq", seq).drop("_opened", "_undated", "_early")


def session_summary(labels: DataFrame) -> DataFrame:
    """One row per session: start, number of impressions, number of clicks."""
    return labels.groupBy("user_id", "session_seq", "session_start").agg(
        F.sum("n_rows").alias("n_impressions"), F.sum("n_clicks").alias("n_clicks")
    )


def assign_sessions(rows: DataFrame, labels: DataFrame, timeout: int = DEFAULT_TIMEOUT) -> DataFrame:
    """``rows`` with the label columns of their slice (those whose slice ``labels`` holds)."""
    wanted = labels.drop("first_ts", "last_ts", "n_clicks")
    return rows.withColumn("slice", slice_of(F.col("timestamp"), timeout)).join(wanted, ["user_id", "slice"])


def last_labels(labels: DataFrame, n: int) -> DataFrame:
    """The slices of each user's ``n`` last sessions; all of them where there are fewer."""
    newest = F.max("session_seq").over(Window.partitionBy("user_id"))
    return labels.withColumn("_newest", newest).filter(F.col("session_seq") > F.col("_newest") - n).drop("_newest")
