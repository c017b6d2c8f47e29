"""Driver-controlled iteration."""
