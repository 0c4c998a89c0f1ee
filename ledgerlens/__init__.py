"""ledgerlens: equity-research analytics as Spark DataFrame operators."""
