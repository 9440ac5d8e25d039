"""PDF bytes as tables, and the writer that makes them."""
