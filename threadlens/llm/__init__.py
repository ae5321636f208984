"""Training-data operators: filtering, deduplication, tagging and tokenising of
web-scale document tables. Nothing else in the library imports this package."""
