"""Road-traffic observation and demand calibration as Spark DataFrame operators."""

__version__ = "0.1.0"
