"""newsfacts: facts reported in online news, as Spark DataFrames."""
