"""Operators for large training corpora. Nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

from webreach.llm import chat, ctw, decontam, forest, importance, license, lines, negatives, packing, pii, quality, secrets, suffix  # noqa: F401  (each registers its query)
from webreach.llm.registry import ORACLE, QUERIES  # noqa: F401

# Functions of this package go to the workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
