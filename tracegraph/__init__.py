"""tracegraph: interaction-trace analytics as plain PySpark jobs."""

__version__ = "0.1.0"
