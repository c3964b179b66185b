"""Corpus operators for training-data pipelines.

Every operator is one module: it has a general interface over DataFrames, and a
thin query in :mod:`review_insights.llm.queries` applies it to a whole table.
Functions of this package travel to executors by value, so a cluster needs no
copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
