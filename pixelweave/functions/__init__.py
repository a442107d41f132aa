"""Column expressions: scalar, geographic, naming and vector functions."""
