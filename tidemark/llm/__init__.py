"""Training-data operators: language ID, deduplication, decontamination, mixing, archives, token files and sharding."""
