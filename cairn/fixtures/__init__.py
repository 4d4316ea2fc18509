"""Makes image bytes for tests and queries."""
