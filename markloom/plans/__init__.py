"""Relations made from documents."""

from .relations import *  # noqa: F403
