"""galley: notation and document analytics as Spark plans."""
