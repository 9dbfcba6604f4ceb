"""Files to entries: one module for each family of formats."""
