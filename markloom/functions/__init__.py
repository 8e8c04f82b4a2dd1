"""Functions of columns: native expressions and Arrow UDFs."""

from .native import *  # noqa: F403
from .udf import *  # noqa: F403
