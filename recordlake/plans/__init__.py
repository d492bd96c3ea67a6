"""Choice of the plan for a request."""
