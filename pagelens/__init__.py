"""Document-parse robustness analytics expressed as Spark DataFrame plans."""
