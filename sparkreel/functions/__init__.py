"""Part of sparkreel."""
