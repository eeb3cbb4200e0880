"""Column builders: no action is run here."""
