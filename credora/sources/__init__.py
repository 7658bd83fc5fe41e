from credora.sources.tables import (  # noqa: F401
    load, nan_to_null, read_table, write_predictions, write_processed,
)
from credora.sources.loans import LOANS_SQL, loans, scored_loans  # noqa: F401
