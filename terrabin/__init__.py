"""A land-cover strata analytics engine on Spark DataFrames."""
