"""Functions of the curation and lookup engine."""
