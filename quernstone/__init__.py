"""quernstone: a PySpark-native engine for versioned, clause-level document evidence."""

import sys

from pyspark import cloudpickle

# functions go to executors with their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

import sys

from pyspark import cloudpickle

# functions go to executors with their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
