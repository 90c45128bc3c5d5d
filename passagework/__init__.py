"""passagework: build a passage index with Spark and search it with Spark.

Documents are split into passages, passages become vectors and postings, and a
*table* of queries is answered against them in one job.  Everything public takes
and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

# Ship the small NumPy helpers with each job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
