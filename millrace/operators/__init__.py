"""Relational operators over journals, payload logs and deliveries."""
