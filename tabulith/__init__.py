"""Semi-typed table analytics expressed as Spark DataFrame operators."""
