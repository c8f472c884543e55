"""Column expressions shared by the parsers, the chunker and the query side."""
