"""Session-memory analytics on Spark: transcripts, indexes and notes as DataFrames."""
