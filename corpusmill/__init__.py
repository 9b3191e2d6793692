"""corpusmill: language-model corpus processing as Spark DataFrame transformations."""
