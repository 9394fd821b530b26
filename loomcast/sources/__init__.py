"""Where series come from and where results go."""
