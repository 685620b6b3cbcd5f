"""quern: an analytics engine on Spark DataFrames, SQL and Structured Streaming."""
