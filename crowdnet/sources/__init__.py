"""sources of the network engine."""
