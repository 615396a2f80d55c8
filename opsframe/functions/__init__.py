"""Column-level functions (T*, P*, F* of the survey). All are built-in Spark
expressions, so they stay inside whole-stage codegen; none is a Python UDF."""

from opsframe.functions.dates import (  # noqa: F401
    boundary_diff, calendar_units, canonical_zone, day_of, days_before, floor_to, week_start, zone_date,
)
from opsframe.functions.logic import (  # noqa: F401
    any_true, at_most_flag, bands, false_or_null, nvl, present_nonzero, ratio,
    to_int, typed_null, when_only,
)
from opsframe.functions.text import (  # noqa: F401
    char_in, concat_strict, decode_access, drop_first_char, left_chars,
    like_contains, split_part,
)
