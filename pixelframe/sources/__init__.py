"""Where relations of pixels come from, and where they go."""
