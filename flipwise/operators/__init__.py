"""flipwise.operators."""
