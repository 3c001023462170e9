"""Query catalogue and SQL oracle."""
