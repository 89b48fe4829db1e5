"""Per-user behavioural features and propensity scoring on Spark DataFrames."""

__version__ = "0.1.0"
