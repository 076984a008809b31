"""streaming of the network engine."""
