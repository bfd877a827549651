"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage; its queries and their SQL
are in :mod:`tessaria.llm.queries`.
"""

import sys

from pyspark import cloudpickle

# Workers then need no copy of this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
