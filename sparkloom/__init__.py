"""A retrieval-analytics and data-processing engine in DataFrame and SQL plans."""
