"""Column functions and small helpers on which the operators rest."""
