"""Product-review analytics as Spark DataFrame transformations.

Sub-packages:
  sources    readers, writers and the review fixture derived from the driver tables
  functions  column expressions (text, numbers, labels, stop words)
  operators  DataFrame -> DataFrame operators (conform, preprocess, summaries,
             scoring, keywords, problems, validation, charts, patterns,
             priority, ROI, benchmark, reports)
  plans      end-to-end phase plans built from the operators
  streaming  the row-wise stages applied to streaming sources
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions and classes of the package travel to executors by value: workers need no copy of it
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
