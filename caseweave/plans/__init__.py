"""Multi-step jobs and the registered query catalogue."""
