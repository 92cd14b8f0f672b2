"""All queries by name, with the SQL twins that an independent engine can run."""

from veritide.plans import evidence, io, joins, quality, ragmetrics, retrieval, rollups, scoring  # noqa: F401
from veritide.plans.base import ORACLES, QUERIES  # noqa: F401
