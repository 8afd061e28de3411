"""Access decisions: credential first, then the client's quota."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.operators.bucket_levels import Quota
from vacantia.operators.credentials import audit_credentials
from vacantia.operators.token_bucket import ROWS_PER_CHUNK, admit_requests
from vacantia.sources.workspace import stage


def decide_access(
    log: DataFrame,
    registry: DataFrame,
    quota: Quota,
    *,
    raw_key: str = "raw_key",
    at: str = "ts",
    tie: str = "event_id",
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """``tie, client_id, status`` of every logged request.

    Only requests with a valid credential draw on the quota; the others keep
    their credential status. Valid ones end as ``ok`` or ``limited``.
    """
    audited = audit_credentials(log, registry, raw_key=raw_key, at=at)
    # Read by both branches and by the sampling pass of the sort.
    audited = stage(audited.select(tie, at, "client_id", "status"), "audited")
    refused = audited.where(F.col("status") != "ok").select(tie, "client_id", "status")
    decided = admit_requests(
        audited.where(F.col("status") == "ok"), quota, at=at, tie=tie, rows_per_chunk=rows_per_chunk
    )
    status = F.when(F.col("admitted"), "ok").otherwise("limited")
    return refused.unionByName(decided.select(tie, "client_id", status.alias("status")))
