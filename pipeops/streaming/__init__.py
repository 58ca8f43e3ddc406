from .operators import deduplicate_event_time, watermark
from .runs import close, drain, drain_complete, drain_updates, with_closing_rows

__all__ = [
    "close",
    "deduplicate_event_time",
    "drain",
    "drain_complete",
    "drain_updates",
    "watermark",
    "with_closing_rows",
]
