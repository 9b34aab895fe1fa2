from tidepanel.functions.calendar import bin_label, bin_sequence, nearest_friday, month_last_friday
from tidepanel.functions.scalars import clean_float, corr_guarded, nullif_zero, safe_div

__all__ = [
    "bin_label", "bin_sequence", "nearest_friday", "month_last_friday",
    "clean_float", "corr_guarded", "nullif_zero", "safe_div",
]
