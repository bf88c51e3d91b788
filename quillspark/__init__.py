"""quillspark: assessment analytics, document processing and corpus operators as plain PySpark jobs."""
