"""postpulse.sources."""
