"""Training-data operators: one module per operator, their queries in ``queries``."""
