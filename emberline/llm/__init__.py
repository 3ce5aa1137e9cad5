"""Operations of a training-data pipeline.  Nothing outside this package imports it.

Functions of this package travel to the executors by value, so that these need neither
the repository nor its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
