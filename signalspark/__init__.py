"""Product and log analytics expressed as Spark DataFrame and streaming jobs."""

from signalspark.functions.filters import Condition, Filter
from signalspark.functions.ranges import Range, parse_range
from signalspark.schema import Frames
from signalspark.session import build_session

__all__ = ["Condition", "Filter", "Frames", "Range", "build_session", "parse_range"]
