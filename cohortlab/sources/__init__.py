"""Text-format readers and table sinks."""
