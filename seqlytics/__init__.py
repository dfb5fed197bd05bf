"""PySpark operators for ordered event sequences of two interacting entities."""

from seqlytics.roles import Roles

__all__ = ["Roles"]
__version__ = "0.1.0"
