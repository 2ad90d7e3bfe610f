"""samplight: approximate and exact aggregate answers on PySpark DataFrames."""

__version__ = "0.1.0"
