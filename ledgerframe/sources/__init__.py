"""Fixed-record files, byte codecs and JSON or XML records."""
