"""Readers for raw files and filtered scans of the stored tables."""
