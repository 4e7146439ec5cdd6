"""muralis: a PySpark-native engine for field observations of building surfaces."""

__version__ = "0.1.0"
