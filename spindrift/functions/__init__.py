"""Part of spindrift: functions."""
