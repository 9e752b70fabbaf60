"""basketlab: e-commerce analytics (catalog rollups, audits, item-to-item
recommendations, conversion scoring, behavioural segmentation) as Spark jobs.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from the
DataFrame API; ``basketlab.plans.registry`` wires them to the driver's tables.
"""

import sys as _sys

__version__ = "0.1.0"

# Functions of this package that run inside Python workers (the pandas cogroup of
# the co-occurrence product, the silhouette scorer) are shipped by value, so
# executors need no installed copy of the package.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001 - older cloudpickle: fall back to by-reference
    pass
