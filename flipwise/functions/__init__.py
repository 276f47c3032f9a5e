"""flipwise.functions."""
