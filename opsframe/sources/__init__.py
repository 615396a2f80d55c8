"""Sources (table resolution, stand-in tables) and sinks."""
