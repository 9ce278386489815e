"""Named queries over the test tables and their SQL equivalents; each module has QUERIES and SQL."""
