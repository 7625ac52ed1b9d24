"""linkloom: a PySpark-native analytics engine for requirements traceability."""

__version__ = "0.1.0"
