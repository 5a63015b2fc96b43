"""The delta algebra, versioned state, and the two incremental maintainers."""
