"""Where telemetry comes from and where results go."""
