"""quirelake: document analytics on Spark DataFrames."""
