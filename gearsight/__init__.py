"""Predictive-maintenance analytics on PySpark DataFrames.

Every public function takes and returns DataFrames (or Columns); nothing
passes rows through the driver.

The few functions that run inside Python workers (``mapInPandas``,
``applyInPandasWithState``) are pickled *by value*, so executors need no
copy of this package on their path.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(sys.modules[__name__])

from gearsight.config import DEFAULT, Settings  # noqa: E402,F401

__all__ = ["DEFAULT", "Settings"]
