"""Markdown knowledge corpora as Spark tables: parsing, indexing, graph, search, quality, review and study jobs."""
