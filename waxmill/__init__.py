"""waxmill: a PySpark-native engine for cataloguing and deduplicating media-like records."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# what runs on executors is sent with its code, so that they need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
