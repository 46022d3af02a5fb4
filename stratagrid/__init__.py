"""Analytics over gridded time series, written for Spark."""
