"""Oracle SQL and the registered queries of the object log."""
