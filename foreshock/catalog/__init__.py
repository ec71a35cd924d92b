"""catalog."""
