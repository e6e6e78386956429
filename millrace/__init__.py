"""millrace: governed, searchable context from raw text, as PySpark DataFrame operators."""
