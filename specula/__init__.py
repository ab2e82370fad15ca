"""specula: a Spark-native analytics engine for forensic signal features."""

__version__ = "0.1.0"
