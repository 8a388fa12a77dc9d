"""Layer sources and sinks."""
