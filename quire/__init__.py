"""quire: marker-tagged text, word alignment, versioning and corpus work as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions that run in executors travel with their job, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
