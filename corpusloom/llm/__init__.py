"""Training-data operators: one module for each, and ``queries`` for the registered queries."""
