"""Document analytics on Spark: sizing, routing, chunking, matching, resolving, linking and reporting."""
