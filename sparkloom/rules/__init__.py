"""rules of the engine."""
