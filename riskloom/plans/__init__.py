"""Feature tables built from the operators."""
