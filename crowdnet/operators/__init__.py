"""operators of the network engine."""
