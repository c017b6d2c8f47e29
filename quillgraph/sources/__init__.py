"""Graphs out of relational tables and CSR files."""
