"""Part of threadloom."""
