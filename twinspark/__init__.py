"""Code-redundancy analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value: no executor has to have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
