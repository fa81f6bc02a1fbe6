"""topicloom: finding and describing topics in large text collections, on Spark.

Every public function takes DataFrames and returns DataFrames.  Rows are
identified by an explicit, unique key column, never by their position.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside Python tasks travel with the job, so executors do
# not need this package on their own import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
