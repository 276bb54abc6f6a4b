"""Operators for preparing training text at scale. Nothing outside this subpackage and
`corpus_pipeline.py` depends on it."""

import sys

from pyspark import cloudpickle

# Tasks get the functions themselves, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
