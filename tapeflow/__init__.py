"""Order-flow analytics as DataFrame operators on Spark."""
