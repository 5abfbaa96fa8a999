"""Attack-surface graph analytics as Spark DataFrame plans."""
