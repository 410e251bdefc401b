"""Event-timing operators of timegrid: operators."""
