"""Plan shapes that keep hot groups from landing in one task."""
