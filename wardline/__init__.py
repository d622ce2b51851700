"""Territory resolution, reporting and corpus preparation on PySpark DataFrames.

Functions handed to Python workers travel by value, so executors need no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
