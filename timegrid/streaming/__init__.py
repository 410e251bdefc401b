"""Event-timing operators of timegrid: streaming."""
