"""docloom: document review, tagging and filing as Spark DataFrame plans."""

__version__ = "0.1.0"
