"""Column functions, and the page parsing helper used inside tasks."""
