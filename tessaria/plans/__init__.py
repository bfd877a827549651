"""Queries over the driver's tables and their SQL, by the rows of the inventory."""

from tessaria.plans import analytics, corpus, files, retrieval, text  # noqa: F401
from tessaria.plans.base import ORACLES, QUERIES  # noqa: F401
from tessaria.plans.retrieval import flagship  # noqa: F401
