"""Spark-native engine for ordered stacks of detector images and the tables they yield.

The subpackages follow the life of a run: ``sources`` parse geometry, cell and file lists,
``functions`` hold column expressions, ``operators`` the data-processing steps, ``streaming``
the stateful noise model, ``sinks`` the six output tables and the text formats, ``plans`` the
end-to-end pipelines and the registered queries.
"""

__version__ = "0.1.0"

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Kernels travel to the executors with the plan, so the package need not be installed there.
register_pickle_by_value(sys.modules[__name__])
