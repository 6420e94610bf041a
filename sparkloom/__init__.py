"""Dataset curation, similarity evaluation and training-data operators on Spark DataFrames."""
