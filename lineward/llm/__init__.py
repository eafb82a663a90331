"""Operators of a training-data pipeline over documents, pages and labels."""

from pyspark import cloudpickle

import lineward

# Arrow functions travel to the executors with their code, which need not be installed there.
cloudpickle.register_pickle_by_value(lineward)
