"""Episode and event-rate analytics as PySpark DataFrame operators."""
