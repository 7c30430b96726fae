"""Document analytics on PySpark: routing, text, captions, layout, scoring and array operators over DataFrames."""

__version__ = "0.1.0"
