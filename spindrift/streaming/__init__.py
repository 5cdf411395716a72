"""Part of spindrift: streaming."""
