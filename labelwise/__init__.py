"""labelwise package."""
