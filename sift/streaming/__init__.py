"""The incremental form of a run."""
