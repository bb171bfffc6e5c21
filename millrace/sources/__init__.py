"""Readers of payload segments, state journals, checkpoints and older stores."""
