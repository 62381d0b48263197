"""Functions of the document-extraction engine."""
