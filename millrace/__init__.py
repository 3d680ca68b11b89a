"""millrace: a PySpark engine for building auditable language-model training corpora."""
