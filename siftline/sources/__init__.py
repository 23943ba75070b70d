"""Where pages and logs come from, and where they go."""
