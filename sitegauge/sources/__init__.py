"""Input tables, derived tables and sinks."""
