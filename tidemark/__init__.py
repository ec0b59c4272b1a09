"""tidemark: walk-forward research over time series, expressed as Spark DataFrame jobs."""
