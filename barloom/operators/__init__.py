"""Operators on bars, signals and trades."""
