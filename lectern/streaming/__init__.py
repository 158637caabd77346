"""Structured Streaming: watermarked windows and keyed state."""
