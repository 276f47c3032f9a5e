"""flipwise.sources."""
