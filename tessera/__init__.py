"""Analytics over wide tables with dynamic column families, planned and run by Spark."""
