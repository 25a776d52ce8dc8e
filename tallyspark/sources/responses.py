"""Service responses (JSON rows) to quota snapshots and plan names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.fixed_values import USAGE_LIMIT_ID

WINDOW = "struct<usedPercent:double,windowDurationMins:bigint,resetsAt:bigint>"
LIMIT = f"struct<limitId:string,primary:{WINDOW},secondary:{WINDOW}>"
RATE_LIMITS = f"rateLimits {LIMIT}, rateLimitsByLimitId map<string,{LIMIT}>, _corrupt string"
ACCOUNT = "account struct<planType:string>, _corrupt string"


def _parsed(body: Column, schema: str) -> Column:
    return F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def _with_parsed(rows: DataFrame, schema: str) -> DataFrame:
    """Add ``_r``, the parsed body of every row.

    As the one item of an exploded array it is parsed once: conditions on its
    fields are not moved before it, where each mention would parse the text again.
    """
    return rows.withColumn("_r", F.explode(F.array(_parsed(F.col("body"), schema))))


def _whole(window: Column) -> Column:
    """Absent, or with all three values in range."""
    full = (
        window.getField("usedPercent").isNotNull()
        & (window.getField("windowDurationMins") >= 0)
        & window.getField("resetsAt").isNotNull()
    )
    return window.isNull() | F.coalesce(full, F.lit(False))


def _sound(limit: Column) -> Column:
    return limit.isNull() | (
        limit.getField("limitId").isNotNull()
        & _whole(limit.getField("primary"))
        & _whole(limit.getField("secondary"))
    )


def parse_rate_limits(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``home, account_id, received_nanos, body`` to ``(snapshots, rejects)``.

    The bucket named like the usage limit is preferred over the general one.
    Rejected: malformed bodies, no bucket, no primary window, negative reset.
    """
    df = _with_parsed(rows, RATE_LIMITS)
    by_id = F.col("_r.rateLimitsByLimitId")
    limit = F.coalesce(F.try_element_at(by_id, F.lit(USAGE_LIMIT_ID)), F.col("_r.rateLimits"))
    df = df.withColumn("_limit", limit)
    all_sound = _sound(F.col("_r.rateLimits")) & F.coalesce(
        F.forall(F.map_values(by_id), lambda entry: entry.isNotNull() & _sound(entry)), F.lit(True)
    )
    reason = (
        F.when(F.col("_r._corrupt").isNotNull() | ~all_sound | F.col("_r").isNull(), "malformed")
        .when(F.col("_limit").isNull(), "no bucket")
        .when(F.col("_limit.primary").isNull(), "no primary window")
        .when((F.col("_limit.primary.resetsAt") < 0) | F.coalesce(F.col("_limit.secondary.resetsAt") < 0, F.lit(False)), "negative reset")
    )
    judged = df.withColumn("reason", reason)

    def window(name: str) -> Column:
        raw = F.col(f"_limit.{name}")
        return F.when(
            raw.isNotNull(),
            F.struct(
                raw["usedPercent"].alias("used_percent"),
                raw["windowDurationMins"].alias("window_minutes"),
                raw["resetsAt"].alias("resets_at"),
            ),
        )

    snapshots = judged.where("reason is null").select(
        "home",
        "account_id",
        F.col("_limit.limitId").alias("limit_id"),
        F.col("received_nanos").alias("ts_nanos"),
        window("primary").alias("primary"),
        window("secondary").alias("secondary"),
        F.lit(None).cast("string").alias("plan_type"),
    )
    return snapshots, judged.where("reason is not null").select("home", "received_nanos", "reason")


def parse_accounts(rows: DataFrame) -> DataFrame:
    """``home, received_nanos, body`` to the plan named in each response."""
    df = _with_parsed(rows, ACCOUNT)
    return df.where(F.col("_r._corrupt").isNull() & F.col("_r").isNotNull()).select(
        "home", F.col("received_nanos").alias("ts_nanos"), F.col("_r.account.planType").alias("plan_type")
    )
