"""Schemas on the driver: normalising, references, and a plain interpreter."""
