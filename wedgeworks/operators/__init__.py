"""DataFrame operators on edges (src, dst)."""
