"""flipwise.plans."""
