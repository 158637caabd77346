"""Operators over DataFrames: reading order, events, tags, notes, segmentation, layout, state."""
