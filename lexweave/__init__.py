"""Document-structure analytics for legal text on Spark DataFrames."""
