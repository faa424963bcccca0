"""Spark jobs for 3-D fragment reassembly data: contact graphs, point clouds,
rigid poses, space-filling curves, neighbour search and evaluation reports."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors need numpy
# and pandas but no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
