"""quillspan: hybrid retrieval, indexing and corpus processing as Spark plans."""
