"""Site registry and geo-association for power plants, as Spark DataFrame operators."""

__version__ = "0.1.0"
