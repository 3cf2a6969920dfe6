"""Training-data operators at corpus scale, one module each, numbered as their queries."""
