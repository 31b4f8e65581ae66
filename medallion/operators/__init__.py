from .ranking import latest_per_key, sort_bounded, top_k, top_n_per_group
from .ratios import conditional_distribution
from .sampling import oversample, resample, split_by_class, undersample
from .upsert import keep_newest, upsert

__all__ = [
    "conditional_distribution", "keep_newest", "latest_per_key", "oversample",
    "resample", "sort_bounded", "split_by_class", "top_k", "top_n_per_group", "undersample",
    "upsert",
]
