from .diagnosis import DEFAULT_RULES, Rule, diagnose, rules_from
from .logs import attribute_log_lines
from .profiles import profile, profile_diff, top_values
from .progress import streaming_progress
from .redaction import redact, redact_value, redaction_counts, secret_literals, unparsable
from .runs import node_profile_diffs, node_schema_diffs, node_snapshots, problem_changes, run_deltas, stage_deltas
from .schemas import (
    schema_changes,
    schema_contract_status,
    schema_diff,
    schema_fields,
    schema_fingerprint,
    schema_timeline,
    snapshot_fields,
)
from .stages import read_event_log, stage_summary
from .trace import Trace

__all__ = [
    "DEFAULT_RULES",
    "Rule",
    "rules_from",
    "Trace",
    "attribute_log_lines",
    "diagnose",
    "node_profile_diffs",
    "node_schema_diffs",
    "node_snapshots",
    "problem_changes",
    "profile",
    "profile_diff",
    "read_event_log",
    "redact",
    "redact_value",
    "redaction_counts",
    "run_deltas",
    "schema_changes",
    "schema_contract_status",
    "schema_diff",
    "schema_fields",
    "schema_fingerprint",
    "schema_timeline",
    "secret_literals",
    "snapshot_fields",
    "stage_deltas",
    "stage_summary",
    "streaming_progress",
    "top_values",
    "unparsable",
]
