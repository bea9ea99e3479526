"""Event-study analytics as lazily planned PySpark DataFrame operators."""

__all__ = ["functions", "operators", "plans", "sources", "settings", "schemas", "runtime"]
