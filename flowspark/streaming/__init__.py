"""The stateless alert rule on streaming frames."""
