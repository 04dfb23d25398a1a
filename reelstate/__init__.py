"""reelstate: media-task state, lookups and detection results as Spark DataFrames."""
