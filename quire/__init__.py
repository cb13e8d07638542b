"""quire: document-structure and text-corpus analytics on Spark DataFrames."""
