"""Column builders: rates, text and flags."""
