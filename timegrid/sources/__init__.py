"""Event-timing operators of timegrid: sources."""
