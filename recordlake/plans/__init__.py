"""Query plans: the registered query catalogue, its SQL oracles and run plans."""
