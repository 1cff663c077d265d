"""Reference operators: functions."""
