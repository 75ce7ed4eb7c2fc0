from pairloom.functions.keys import clean_key, digest_key
from pairloom.functions.math import erf_expr, normal_cdf

__all__ = ["clean_key", "digest_key", "erf_expr", "normal_cdf"]
