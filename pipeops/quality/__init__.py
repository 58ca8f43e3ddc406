from .checks import (
    apply_column_rule,
    check_columns,
    observe_rule,
    profile_probe,
    quarantine_split,
    referential,
    referential_missing,
    schema_contract,
    uniqueness,
    uniqueness_duplicates,
)
from .suite import run_suite, suite_status

__all__ = [
    "apply_column_rule",
    "check_columns",
    "observe_rule",
    "profile_probe",
    "quarantine_split",
    "referential",
    "referential_missing",
    "run_suite",
    "schema_contract",
    "suite_status",
    "uniqueness",
    "uniqueness_duplicates",
]
