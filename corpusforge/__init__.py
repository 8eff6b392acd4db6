"""corpusforge: labelled tables in, instruction corpora and scores out, as Spark DataFrames."""
