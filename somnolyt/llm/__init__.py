"""Operators for large-scale training-data pipelines (texts and chats)."""
