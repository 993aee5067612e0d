"""Document retrieval on Spark: ingest, chunk, index, search, cite and quote as DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
