"""Named query plans over a folder of tables."""
