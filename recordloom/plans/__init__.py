"""Jobs composed of operators: the archive's life, list pages and the registered queries."""
