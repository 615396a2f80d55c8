"""Report plans (R1-R32, X1): each a function ``(tables, **params) -> DataFrame``."""
