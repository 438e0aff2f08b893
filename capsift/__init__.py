"""capsift: analytics over captured command and log output, as Spark jobs."""

__version__ = "0.1.0"
