"""Query plans, parameters, timed runs, log analytics and the query catalog."""
