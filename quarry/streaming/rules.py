"""Running metrics of rules per application, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rule_metrics(applications: DataFrame) -> DataFrame:
    """Per rule of (rule_id, user_action, feedback_score, applied_at): uses, accepted, rejected, share accepted, mean feedback, last use.

    A modified application is neither accepted nor rejected. As a stream: output mode complete or update.
    """
    accepted, rejected = F.count_if(F.col("user_action") == "accepted"), F.count_if(F.col("user_action") == "rejected")
    judged = accepted + rejected
    return applications.groupBy("rule_id").agg(
        F.count("*").alias("uses"), accepted.alias("accepted"), rejected.alias("rejected"),
        F.when(judged > 0, accepted / judged).otherwise(0.0).alias("acceptance"), F.avg("feedback_score").alias("feedback"), F.max("applied_at").alias("last_used"),
    )


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", time: str = "ts") -> DataFrame:
    """Events by type and window, with a watermark: windows close once `late` has passed behind them."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", user: str = "user_id", time: str = "ts") -> DataFrame:
    """Topic sessions: events of a user with no gap longer than `gap`."""
    return events.withWatermark(time, late).groupBy(user, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")
