"""Operators for large text corpora, each beside its registered query and SQL twin."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need only the libraries, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
