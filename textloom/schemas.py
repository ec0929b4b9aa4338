"""Explicit schemas of every table the engine reads or writes; nothing is inferred."""

from pyspark.sql import types as T

_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


JOBS = _struct(
    id=_S, status=_S, total=_L, completed=_L, successful=_L, failed=_L, created_at=_S, updated_at=_S
)

JOB_ITEMS = _struct(
    id=_S, job_id=_S, url=_S, status=_S, method=_S, title=_S, text=_S, text_length=_L,
    final_url=_S, error=_S, duration_ms=_L, created_at=_S, updated_at=_S,
)

#: Append-only transitions of items. kind: created, processing, result, retry, dead.
ITEM_LOG = _struct(
    id=_S, job_id=_S, url=_S, seq=_L, kind=_S, status=_S, method=_S, title=_S, text=_S,
    text_length=_L, final_url=_S, error=_S, duration_ms=_L, ts=_S,
)

#: Append-only job rows. kind: created, enqueue_failed.
JOB_LOG = _struct(id=_S, seq=_L, kind=_S, total=_L, error=_S, ts=_S)

#: not_before: milliseconds since 1970 before which a retry is held back; null: due at once.
MESSAGE = _struct(type=_S, jobId=_S, itemId=_S, url=_S, attempts=_I, not_before=_L)

FETCHED = _struct(
    pos=_I, url=_S, http_status=_I, content_type=_S, final_url=_S, body=T.BinaryType(),
    fetch_error=_S, duration_ms=_L,
)

RENDERED = _struct(
    pos=_I, url=_S, http_status=_I, final_url=_S, raw_title=_S, raw_text=_S, render_error=_S,
    duration_ms=_L,
)

RESULT = _struct(
    pos=_I, requestedUrl=_S, success=_B, method=_S, status=_I, finalUrl=_S, title=_S, textLength=_L,
    stillLoading=_B, blocked=_B, text=_S, fallbackReason=_S, error=_S, durationMs=_L,
)
