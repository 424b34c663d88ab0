"""Counts of streams that add up over batches."""
