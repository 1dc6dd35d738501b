"""Training-data operators: quality, dedup, decontamination, tokens, packing and language-model scores."""
