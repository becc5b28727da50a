"""Mass-appraisal analytics for property data, written as Spark DataFrame jobs."""
