"""Composite operators built from the single ones."""
