"""Training-data operators: dedup, decontamination, extraction, filtering, tokenising."""
