"""Analytics over Spark DataFrames."""

from .frame import Frame, concat
from .session import get_session

__all__ = ["Frame", "concat", "get_session"]
__version__ = "0.1.0"
