"""Column functions."""

from candlemill.functions.arith import safe_div, whole_lots
from candlemill.functions.boards import amplitude, amplitude_limit
from candlemill.functions.days import business_day_gap, day_number

__all__ = ["amplitude", "amplitude_limit", "business_day_gap", "day_number", "safe_div", "whole_lots"]
