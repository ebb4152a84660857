"""plurality: vote-labelled signal and evaluation analytics as Spark jobs."""

__version__ = "0.1.0"
