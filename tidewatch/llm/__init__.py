"""Corpus preparation for language-model training, on Spark.

Nothing else in the library imports this subpackage.  Every operator takes DataFrames and column names, covers
all rows and whole texts, and leaves intermediate tables only in the shared folder named by ``spark.checkpoint.dir``.
"""
