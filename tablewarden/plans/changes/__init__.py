"""Batches of change requests, applied to the registry."""

from tablewarden.plans.changes.columns import column_add, column_drop, column_modify
from tablewarden.plans.changes.common import Change, run_changes
from tablewarden.plans.changes.indexes import index_create, index_drop
from tablewarden.plans.changes.sequences import sequence_alter, sequence_create, sequence_drop
from tablewarden.plans.changes.tables import leftover_sequences, table_create, table_drop

APPLY = {
    "table_create": table_create,
    "table_drop": table_drop,
    "column_add": column_add,
    "column_modify": column_modify,
    "column_drop": column_drop,
    "index_create": index_create,
    "index_drop": index_drop,
    "sequence_create": sequence_create,
    "sequence_alter": sequence_alter,
    "sequence_drop": sequence_drop,
}

__all__ = ["APPLY", "Change", "leftover_sequences", "run_changes", *APPLY]
