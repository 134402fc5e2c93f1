"""Column-level building blocks: geometry, coordinate systems, GeoJSON text."""
