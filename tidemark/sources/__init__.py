"""Front doors: JSON exports (record mode) and tables (table mode)."""
