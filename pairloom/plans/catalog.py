"""All named queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from . import experiments, maps, networks, reports, summaries  # noqa: F401  they register their queries
from .registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "m01_stress_si"
