"""sprocket: a PySpark-native analytics library for media catalogs."""

__version__ = "0.1.0"
