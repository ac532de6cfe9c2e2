"""Training-data operators: quality, deduplication, decontamination, tokenisation, archives, chat."""
