from edgeloom.functions.hashing import mix31, mix31_int, rank_hash
from edgeloom.functions.normal import erfc, norm_cdf, norm_ppf, norm_sf, two_sided_p

__all__ = [
    "erfc", "mix31", "mix31_int", "norm_cdf", "norm_ppf", "norm_sf", "rank_hash", "two_sided_p",
]
