"""Query plans over the driver tables: fixture derivations, the query
registry and the end-to-end report job."""
