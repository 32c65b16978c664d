"""Query plans over the named tables, and datasets resolved from one another."""
