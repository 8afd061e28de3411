"""Attribution of logged requests to registered clients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.functions.columns import key_digest, own_shuffle


def audit_credentials(
    log: DataFrame,
    registry: DataFrame,
    *,
    raw_key: str = "raw_key",
    at: str = "ts",
) -> DataFrame:
    """Add ``client_id`` and ``status`` to the log; the raw key leaves the output.

    Status, in this order: ``missing`` (no key), ``unknown`` (no client has it),
    ``expired`` (later than ``expires_at``; NULL never expires), ``ok``.
    ``registry`` holds ``client_id, key_sha256, expires_at``. A digest that
    several clients share belongs to the first client id, so no log row repeats.

    Rows without a key take no part in the join, where they would all meet in one
    partition; both parts read the log with their own filter.
    """
    owners = (
        registry.groupBy("key_sha256")
        .agg(F.min(F.struct("client_id", "expires_at")).alias("owner"))
        .select(own_shuffle("key_sha256").alias("key_sha256"), "owner.*")
    )
    kept = [name for name in log.columns if name != raw_key]
    has_key = F.coalesce(F.col(raw_key) != "", F.lit(False))
    hashed = log.where(has_key).select(*kept, key_digest(raw_key).alias("key_sha256"))
    keyless = log.where(~has_key).select(
        *kept,
        F.lit(None).cast(owners.schema["client_id"].dataType).alias("client_id"),
        F.lit("missing").alias("status"),
    )
    status = (
        F.when(F.col("client_id").isNull(), "unknown")
        .when(F.col(at) > F.col("expires_at"), "expired")
        .otherwise("ok")
    )
    found = hashed.join(owners, "key_sha256", "left").select(*kept, "client_id", status.alias("status"))
    return found.unionByName(keyless)
