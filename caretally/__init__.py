"""Clinical-operations reporting on Spark: DataFrame operators and report plans."""
