"""Growing files as streams."""
