"""Local-business web-presence analytics as set-oriented Spark jobs."""

__version__ = "0.1.0"
