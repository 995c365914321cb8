"""Ready-made query plans over the standard tables."""
