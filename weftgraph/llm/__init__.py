"""Training-data operators: thirteen Spark jobs over tables of documents, pages and embeddings.

Nothing outside this subpackage imports it.
"""
