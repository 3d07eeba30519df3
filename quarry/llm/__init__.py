"""Operators of a training-data pipeline: tokens, mixing, duplicates, quality, chat, language, URLs, lines."""
