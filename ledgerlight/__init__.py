"""Credit-history feature, scoring and audit jobs written for PySpark."""

__version__ = "0.1.0"
