"""functions of the network engine."""
