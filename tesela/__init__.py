"""tesela: analytics over corpora of typed documents, on Spark DataFrames."""
