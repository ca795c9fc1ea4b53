"""tagwright: build machine-labelled text-classification datasets and
evaluate classifiers on them, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.2.0"

# Functions that run in tasks travel with the job, so workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
