"""A PySpark-native engine for mesh deformation, spatial analytics and corpus preparation."""

__version__ = "0.1.0"
