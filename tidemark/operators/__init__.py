"""Domain-free DataFrame operators."""
