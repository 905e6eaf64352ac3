"""barloom: a Spark feature engine for ordered market and event time series."""
