"""Plans of the curation and lookup engine."""

from . import inventory  # noqa: F401  adds its queries to those of .queries
