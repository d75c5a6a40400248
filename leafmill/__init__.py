"""leafmill: a Spark-first engine for collections of files, tables and training text."""
