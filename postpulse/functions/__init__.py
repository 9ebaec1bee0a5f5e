"""postpulse.functions."""
