"""Operators of a training-data pipeline: packing, mixing, neighbours, deduplication, quality, archives, chats."""
