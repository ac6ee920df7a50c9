"""Paper analytics engine on Spark DataFrames."""
