"""Sources: document scans with format routing, derived input tables, sinks."""
