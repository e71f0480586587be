"""The given tables seen as calls, and the registered queries."""
