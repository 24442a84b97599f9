"""airgrid: gridded-observation analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions that run in Python tasks travel with them: executors need numpy and pandas, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
