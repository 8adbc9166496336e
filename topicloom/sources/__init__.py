"""Sources: paged feeds and tables."""
