"""The operators as continuous jobs."""
