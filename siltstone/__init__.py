"""A corpus engine on Spark: text cleaning, filtering, deduplication, chat sets, packing and planning as DataFrames."""
