"""Training-data operators: mixing, media, language, dedup, chat, quality, packing, WARC."""
