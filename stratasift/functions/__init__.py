"""Column helpers: names and keys, IEEE division, seeded priorities."""
