"""Document and validity-period analytics as Spark DataFrame programs."""
