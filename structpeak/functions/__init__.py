"""Column-level building blocks: array shapes, guarded scalars and seeded draws."""

from structpeak.functions.arrays import (
    assemble_channels,
    bound,
    central_difference,
    pad_to,
    rolling_spread,
)
from structpeak.functions.draws import key_seed, order_digest, uniform
from structpeak.functions.scalars import (
    finite,
    guarded_ratio,
    like_class,
    minutes_between,
    relative_error,
    version_text,
)

__all__ = [
    "assemble_channels",
    "bound",
    "central_difference",
    "finite",
    "guarded_ratio",
    "key_seed",
    "like_class",
    "minutes_between",
    "order_digest",
    "pad_to",
    "relative_error",
    "rolling_spread",
    "uniform",
    "version_text",
]
