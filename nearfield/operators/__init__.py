"""Search, clustering and index operators."""
