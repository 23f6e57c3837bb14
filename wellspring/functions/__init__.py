"""Column builders and the small array kernels behind pandas UDFs."""
