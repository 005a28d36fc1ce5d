"""End-to-end plans, and the registry of runnable queries."""
