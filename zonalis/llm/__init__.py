"""Operators for preparing training data, each a set of Spark jobs over a table of documents or pages."""
