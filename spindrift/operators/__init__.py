"""Part of spindrift: operators."""
