"""Analytics over system-call traces on Spark."""

from tracecairn.options import TraceOptions

__all__ = ["TraceOptions"]
