"""Part of radloom."""
