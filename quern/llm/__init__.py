"""Training-data operators: tokenising, scoring, searching, deduplicating and packing."""
