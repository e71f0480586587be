"""Training-data operators: classification, deduplication, decontamination, archives and packing."""
