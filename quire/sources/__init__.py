"""Readers, writers and adapters.

Functions of this subpackage that run on executors travel by value, so executors need only the libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
