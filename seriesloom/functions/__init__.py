from .special import (
    digamma,
    gamma_cdf,
    gamma_shape,
    log_gamma,
    norm_ppf,
    trigamma,
)
from .text import strip_whitespace, title_case

__all__ = [
    "digamma",
    "gamma_cdf",
    "gamma_shape",
    "log_gamma",
    "norm_ppf",
    "strip_whitespace",
    "title_case",
    "trigamma",
]
