"""postpulse.operators."""
