"""Code-corpus snapshots and symbol analytics as Spark DataFrame operators."""
