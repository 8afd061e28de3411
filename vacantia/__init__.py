"""Job-posting analytics expressed as Spark DataFrame jobs."""
