"""Graph text sources and sinks."""
