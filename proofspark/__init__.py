"""Temperature time series and fermentation sessions as Spark jobs."""
