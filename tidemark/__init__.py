"""Event studies over text, expressed as Spark DataFrame plans."""
