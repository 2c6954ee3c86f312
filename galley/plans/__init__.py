"""galley.plans: the queries of the core, with the same queries in SQL."""
