"""Search of function catalogues by name and type signature, as Spark DataFrame jobs."""
