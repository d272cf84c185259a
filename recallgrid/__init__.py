"""Analytics over agent-memory tables, expressed as Spark DataFrame plans."""
