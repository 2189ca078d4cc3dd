"""Analytics over text and source corpora, written as Spark DataFrames."""
