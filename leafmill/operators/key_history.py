"""Keys over time: what a key was when a request came, not what it is now."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CREATED, REVOKED = "create", "revoke"


def validity(history: DataFrame) -> DataFrame:
    """(key_id, api_key, name, at, action) to intervals: api_key, key_id, name, state, valid_from, valid_to (null: open).

    The intervals of a known key cover all times and don't overlap: before its first event it is ``absent`` (valid_from
    null), afterwards ``active`` or ``revoked``.  Of events at the same time a revocation counts last; an event that
    changes nothing (a second revocation, a second creation of the same key_id) makes no interval of its own.
    """
    later = F.when(F.col("action") == REVOKED, 1).otherwise(0)
    order = Window.partitionBy("api_key").orderBy("at", later, "key_id")
    state = F.when(F.col("action") == REVOKED, "revoked").otherwise("active")
    rows = history.select("api_key", "key_id", "name", "at", "action").withColumn("state", state)
    same = (F.lag("state").over(order) == F.col("state")) & ((F.col("state") == "revoked") | F.lag("key_id").over(order).eqNullSafe(F.col("key_id")))
    rows = rows.withColumn("same", F.coalesce(same, F.lit(False))).where("not same")
    rows = rows.withColumn("valid_to", F.lead("at").over(order)).where("valid_to is null or valid_to > at")
    known = rows.select("api_key", "key_id", "name", "state", F.col("at").alias("valid_from"), "valid_to")
    before = history.groupBy("api_key").agg(F.min("at").alias("valid_to"))
    never = lambda c: F.lit(None).cast(history.schema[c].dataType).alias(c)
    absent = before.select("api_key", never("key_id"), never("name"), F.lit("absent").alias("state"), never("at").alias("valid_from"), "valid_to")
    return known.unionByName(absent)


def requests_at_time(requests: DataFrame, history: DataFrame) -> DataFrame:
    """requests (api_key, ts, ...) with key_id, state (active, revoked, absent, unknown) and authorised, by the key's state at ts.

    An equi-join on the key with a range on the time: a key has few intervals, one of which holds, so a request is
    one row before and after, and a key with very many requests is split like any skewed join.
    """
    spans = validity(history).withColumnsRenamed({"api_key": "_key"})
    at = (F.col("valid_from").isNull() | (F.col("ts") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("ts") < F.col("valid_to")))
    both = requests.join(spans, (F.col("api_key") == F.col("_key")) & at, "left")
    state = F.coalesce("state", F.lit("unknown"))
    return both.select(*requests.columns, "key_id", state.alias("state"), (state == "active").alias("authorised"))


def usage_over_time(requests: DataFrame, history: DataFrame) -> DataFrame:
    """Every key_id with its authorised requests, the last of them, whether it is active at the end, and how long it was active (seconds; to the last event or request)."""
    judged = requests_at_time(requests, history).where("authorised")
    used = judged.groupBy("key_id").agg(F.count(F.lit(1)).alias("request_count"), F.max("ts").alias("last_used_at"))
    spans = validity(history).where("state = 'active'")
    keys = spans.groupBy("key_id").agg(F.max(F.col("valid_to").isNull()).alias("is_active"), F.min("valid_from").alias("created_at"), F.max("valid_to").alias("_to"))
    out = keys.join(used, "key_id", "left")
    revoked = F.when(~F.col("is_active"), F.col("_to"))
    return out.select("key_id", "created_at", revoked.alias("revoked_at"), "is_active", F.coalesce("request_count", F.lit(0)).alias("request_count"), "last_used_at")


def revoked(history: DataFrame, key_ids: DataFrame, at) -> DataFrame:
    """The history with revocations of the given keys (key_id) at a time; keys that are unknown or no longer active add nothing."""
    active = validity(history).where("state = 'active' and valid_to is null").join(key_ids.select("key_id").distinct(), "key_id", "left_semi")
    rows = active.select("key_id", "api_key", "name", F.lit(at).cast(history.schema["at"].dataType).alias("at"), F.lit(REVOKED).alias("action"))
    return history.select("key_id", "api_key", "name", "at", "action").unionByName(rows)


def primary_at(history: DataFrame, at) -> DataFrame:
    """key_id and api_key of the key that was created first of those active at a time; no row where none is."""
    when = F.lit(at).cast(history.schema["at"].dataType)
    live = validity(history).where((F.col("state") == "active") & (F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))
    return live.orderBy("valid_from", "key_id").limit(1).select("key_id", "api_key")
