"""wikilake: document-corpus analytics on Spark DataFrames."""
