"""DataFrame operators over readings."""
