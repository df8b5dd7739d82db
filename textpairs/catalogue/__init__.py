"""Example inputs derived from the sample tables, the query catalogue over them, and its SQL counterparts."""
