"""Table readers, derived views and shared storage."""
