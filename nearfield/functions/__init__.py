"""Similarities, codings and rotation."""
