"""Hourly tables per map cell from gauges, level sensors, footprints, terrain and rivers."""
