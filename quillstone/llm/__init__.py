"""Training-data operators: decontamination, media columns, deduplication, language, quality, packing and extraction."""
