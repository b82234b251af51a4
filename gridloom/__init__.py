"""Gridloom: transactional, multi-versioned, chunked integer arrays on Spark."""
