"""quillrock: permission-aware retrieval analytics on PySpark."""
