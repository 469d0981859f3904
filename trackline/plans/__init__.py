"""Tables and page queries composed from the operators."""
