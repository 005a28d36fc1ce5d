"""tallyloom: metadata and operational analytics as Spark DataFrame operators."""
