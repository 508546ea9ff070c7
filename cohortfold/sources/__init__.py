"""Connections (JDBC, files) and the given tables as record sources."""
