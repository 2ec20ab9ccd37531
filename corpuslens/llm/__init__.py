"""Training-data operators: deduplication, language, tokens, packing, chat, media."""
