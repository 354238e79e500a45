"""DataFrame to DataFrame steps, one per operator family."""
