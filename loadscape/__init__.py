"""Fixed-grid time series (electricity meters and the like) on Spark: cleaning, profiles, clustering, scenarios, scores."""
