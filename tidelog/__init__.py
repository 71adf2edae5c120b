"""tidelog: an analytics engine over immutable facts, on Spark DataFrames."""
