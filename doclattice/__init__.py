"""Document analytics on Spark: whole corpora and whole query batches as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code: workers need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
