"""The estimator and the registered queries."""
