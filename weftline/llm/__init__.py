"""Training-data operators: one module per operator, with their queries in ``queries``."""
