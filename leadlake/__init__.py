"""leadlake: lead-intelligence and outreach analytics on Spark DataFrames."""
