"""tidewell: story analytics over article feeds, expressed on Spark DataFrames."""
