"""Reference operators: sources."""
