"""siftstone: catalogue, search and de-duplicate very large file collections with PySpark."""
