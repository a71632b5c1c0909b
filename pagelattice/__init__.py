"""Page-structure analytics expressed as Spark DataFrame plans."""
