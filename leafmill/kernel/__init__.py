"""Byte-level parsing of PDF documents, in plain Python: no Spark imports here."""
