"""Composite analyses, and the named queries over the test tables with their SQL."""
