"""Quotes to bars to features as streams."""
