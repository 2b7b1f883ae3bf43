"""Where results and builds go."""
