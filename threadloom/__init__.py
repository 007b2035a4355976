"""Search and curation of chat transcripts as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
