"""Training-data operators: quality rules, counting, archives, near-duplicates, repeats, tokenisation."""
