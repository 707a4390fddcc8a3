"""Reusable pieces of logical plans."""
