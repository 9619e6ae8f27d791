"""Property graphs of symbols on Spark: matching, traversal, comparison, merging, storage and rendering."""
