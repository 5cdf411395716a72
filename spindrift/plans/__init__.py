"""Part of spindrift: plans."""
