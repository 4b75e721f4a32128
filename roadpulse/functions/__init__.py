from roadpulse.functions.columns import (  # noqa: F401
    coordinate_part,
    day_type,
    floor_at_zero,
    indicator,
    normalize_header,
    parse_timestamp,
    pct_drop,
    rounded,
    sd_from_variance,
    strip_whitespace,
    to_number,
)
