"""lectern: a PySpark-native engine for curating catalogues of messy text and answering name lookups."""

import sys

from pyspark import cloudpickle

# Workers receive this package's Python functions by value, so a cluster needs no copy of it on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
