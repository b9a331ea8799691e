"""Training-data operators: dedup, decontamination, quality rules, extraction, archives and packing."""
