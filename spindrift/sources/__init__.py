"""Part of spindrift: sources."""
