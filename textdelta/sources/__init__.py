"""Where text pairs come from."""
