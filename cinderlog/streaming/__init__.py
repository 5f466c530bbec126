"""The log path on streams."""
