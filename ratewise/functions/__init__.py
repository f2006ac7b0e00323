from ratewise.functions.columns import (  # noqa: F401
    clip, cyclic, fin, lead_time_bucket, map_lookup, occ_band,
    relabel, rnd, sample_skew, season, year_month,
)
