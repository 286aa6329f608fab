"""Operators of a training-data pipeline, each a function from DataFrames to DataFrames.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it.
"""

from pyspark import cloudpickle

import millrace

# Python workers get the package's functions with the task, so they need no installed copy.
cloudpickle.register_pickle_by_value(millrace)
