"""Event-timing analytics on Spark: bars, grids, phases, periods, loops and reports for any keyed event stream."""
