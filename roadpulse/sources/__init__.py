from roadpulse.sources.fixtures import events, fixed_assignment, observations, raw_text  # noqa: F401
from roadpulse.sources.raw import CLEAN_SCHEMA, RAW_SCHEMA, clean, normalize_columns, parsed, read_raw  # noqa: F401
from roadpulse.sources.tables import (  # noqa: F401
    load_table,
    register,
    save_bucketed,
    write_clean_observations,
    write_table,
)
