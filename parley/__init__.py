"""Table-scale analytics for recorded conversations, declared with Spark DataFrames."""
