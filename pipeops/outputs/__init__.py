from .cdc import CdcTarget, cdc_scd1
from .datasets import (
    append_flow,
    external_sink,
    materialized_view,
    read_flows,
    streaming_table,
    temporary_view,
)
from .preview import explain_text, preview
from .refresh import Dataset, refresh

__all__ = [
    "CdcTarget",
    "Dataset",
    "append_flow",
    "cdc_scd1",
    "explain_text",
    "external_sink",
    "materialized_view",
    "preview",
    "read_flows",
    "refresh",
    "streaming_table",
    "temporary_view",
]
