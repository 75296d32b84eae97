"""folioflow: retrieval and text analytics over document libraries, as Spark DataFrame plans."""

__version__ = "0.1.0"
