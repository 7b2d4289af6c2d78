from broodline.functions.nulls import (  # noqa: F401
    asc_nl, count_true, join_null_safe, keep_first, n_distinct_na, not_in,
    safe_div, sole_value, r_round, left_plus_missing, first_last_by,
)
from broodline.functions.clean import (  # noqa: F401
    experiment_flag, recode_experiment, coalesce_versions, date_observed_columns, clutch_order,
)
