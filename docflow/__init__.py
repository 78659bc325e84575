"""docflow: document classification, routing, extraction and assembly as Spark DataFrame plans."""

__version__ = "0.1.0"
