"""API keys as a dimension table beside a request log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import masked


def authorised(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Requests whose key is known and active."""
    return requests.join(keys.where("is_active").select("api_key"), "api_key", "left_semi")


def key_usage(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """Every key with the number of its valid requests and the time of the last one."""
    used = authorised(requests, keys).groupBy("api_key").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_used_at"))
    return keys.join(used, "api_key", "left").select("key_id", "is_active", F.coalesce("n", F.lit(0)).alias("request_count"), "last_used_at")


def listed(keys: DataFrame) -> DataFrame:
    return keys.select("key_id", "name", masked(F.col("api_key")).alias("api_key"), "created_at", "is_active")


def primary(keys: DataFrame) -> DataFrame:
    """The first active key."""
    return keys.where("is_active").agg(F.min_by("key_id", F.struct("created_at", "key_id")).alias("key_id"))


def presented(bearer: Column, custom: Column, plain: Column, parameter: Column) -> Column:
    """The key of a request, by precedence; blank ones count as missing."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in (F.regexp_replace(bearer, "(?i)^bearer ", ""), custom, plain, parameter)))
