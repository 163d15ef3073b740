"""cohortlens: evaluation of multi-label predictions across cohorts, on Spark DataFrames."""
