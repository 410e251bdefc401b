"""Event-timing operators of timegrid: functions."""
