"""Analytics over collections of postings and similar documents, as Spark DataFrames."""
