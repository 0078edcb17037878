"""Writers for examples, text lines and model blocks."""
