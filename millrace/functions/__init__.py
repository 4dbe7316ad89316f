"""Column builders with the dialect's value rules."""
