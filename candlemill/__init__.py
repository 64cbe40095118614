"""Daily-bar equity analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from candlemill.params import ScreenParams, TradeParams

# Functions go to the Python workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["ScreenParams", "TradeParams"]
