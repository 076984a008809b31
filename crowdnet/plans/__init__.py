"""plans of the network engine."""
