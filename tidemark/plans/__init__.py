"""End-to-end programs built from sources, operators and sinks."""
