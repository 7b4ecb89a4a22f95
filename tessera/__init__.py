"""tessera: keyed-table, similarity-search and measurement analytics on Spark."""
