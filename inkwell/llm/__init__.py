"""Training-data operators (deduplication, decontamination, tokenisation, ...). Nothing else in inkwell imports this."""
