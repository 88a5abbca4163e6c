"""Plans: the end-to-end report job and the registered queries."""
