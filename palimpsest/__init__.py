"""Analytics over conversations and texts: classify, redact, rewrite, deduplicate, rank and measure."""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Workers need no import path to this package: its functions travel by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
