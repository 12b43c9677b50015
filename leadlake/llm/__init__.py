"""Training-data operators: deduplication, scoring, extraction, encoding, mixing and fingerprints."""

import sys

from pyspark import cloudpickle

# The functions that tasks run travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
