"""Operators of a training-data pipeline: quality, archives, packing, decontamination, sharding, tokens, near-duplicates, urls.

The Python helpers that run inside tasks travel to the executors by value, so the package need not be installed there.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
