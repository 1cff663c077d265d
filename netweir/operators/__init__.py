"""Reference operators: operators."""
