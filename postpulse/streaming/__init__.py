"""postpulse.streaming."""
