from .staging import drop_staged, stage, staging_root
from .tables import counted, read_many, read_table, row_count, row_counts, write_metrics_json, write_table

__all__ = [
    "counted",
    "drop_staged",
    "read_many",
    "read_table",
    "row_count",
    "row_counts",
    "stage",
    "staging_root",
    "write_metrics_json",
    "write_table",
]
