"""End-to-end plans: the facade, and the registered queries with their SQL."""
