"""Reference operators: streaming."""
