"""Scalar functions as native Column expressions (whole-stage codegen, no UDFs)."""

from seasoncast.functions.parse import *  # noqa: F401,F403
from seasoncast.functions.measures import *  # noqa: F401,F403
from seasoncast.functions.vectors import *  # noqa: F401,F403
