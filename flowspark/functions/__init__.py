"""Column functions: stateless expressions usable on batch and streaming frames."""
