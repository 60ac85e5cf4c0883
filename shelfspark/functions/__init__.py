"""Column-level helpers shared by all operators (JVM-side expressions only)."""

from shelfspark.functions.ranking import minmax_within, top_k
from shelfspark.functions.timecols import whole_days

__all__ = ["top_k", "minmax_within", "whole_days"]
