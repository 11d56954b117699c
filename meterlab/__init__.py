"""Smart-meter analytics as PySpark DataFrame operators.

Layout
------
``functions``  column expressions (calendar keys, strict means, moments)
``operators``  DataFrame -> DataFrame building blocks
``plans``      chains of operators: cleaning, stationary series, ranking
``sources``    readers and writers
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few functions that run inside Python tasks travel with the job, so workers
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
