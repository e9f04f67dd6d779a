"""Column-level helpers (``Column -> Column``); all are built-in Spark expressions."""

from .scalars import *  # noqa: F401,F403
from .rules import *  # noqa: F401,F403
