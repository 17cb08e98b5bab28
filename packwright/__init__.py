"""Evidence analytics on PySpark: pure DataFrame-to-DataFrame operators over pages, documents and responses."""
