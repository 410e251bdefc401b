"""Event-timing operators of timegrid: plans."""
