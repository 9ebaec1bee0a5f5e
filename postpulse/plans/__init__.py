"""postpulse.plans."""
