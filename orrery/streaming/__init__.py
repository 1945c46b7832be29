"""Extension: the per-patient counts kept up to date over a stream."""
