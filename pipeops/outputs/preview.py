"""A bounded look at a result. The bound is the feature: use the full operators for answers."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame

# Fixed value: the most rows a preview shows.
MAX_ROWS = 200


def preview(
    df: DataFrame, limit: int = MAX_ROWS, fraction: float | None = None, seed: int | None = None
) -> DataFrame:
    if df.isStreaming:
        raise ValueError("preview the table a stream has written, not the stream")
    if not 1 <= limit <= MAX_ROWS:
        raise ValueError(f"limit must be between 1 and {MAX_ROWS}")
    if fraction is not None:
        if not 0 < fraction <= 1:
            raise ValueError("fraction must be above 0 and at most 1")
        df = df.sample(False, fraction, seed)
    return df.limit(limit)


def explain_text(df: DataFrame, mode: str = "extended") -> str:
    """The plan as text, the input of :func:`pipeops.plans.plan_nodes`."""
    buffer = io.StringIO()
    with contextlib.redirect_stdout(buffer):
        df.explain(mode=mode)
    return buffer.getvalue()
