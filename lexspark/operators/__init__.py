"""DataFrame operators over an index."""
