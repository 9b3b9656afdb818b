"""A lexical search and ranking engine on Spark DataFrames."""
