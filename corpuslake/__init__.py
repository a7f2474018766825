"""corpuslake: multi-tenant corpus analytics on Spark DataFrames."""
