"""What runs end to end: estimation of external and internal performance, and the registered queries."""
