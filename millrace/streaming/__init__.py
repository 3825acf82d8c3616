"""Fitted steps and resampling on streaming tables."""
