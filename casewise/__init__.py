"""Decision analytics on Spark DataFrames: labels, features, clusters, bandit scores."""

__version__ = "0.1.0"
