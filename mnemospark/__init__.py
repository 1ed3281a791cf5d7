"""Evidence-backed, bitemporal memory and retrieval analytics as Spark plans."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
