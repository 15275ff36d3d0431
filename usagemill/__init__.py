"""Usage metering, accumulation, aggregation and reports as Spark jobs."""
