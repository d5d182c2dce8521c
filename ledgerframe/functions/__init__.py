"""Column builders: every rule is an expression that Catalyst sees."""
