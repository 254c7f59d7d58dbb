"""A dataframe analytics engine on Spark."""
