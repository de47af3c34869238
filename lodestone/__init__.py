"""lodestone: storage, compression and corpus analytics expressed Spark-first."""

__version__ = "0.1.0"
