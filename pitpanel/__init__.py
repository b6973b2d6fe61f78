"""pitpanel: point-in-time panel analytics as plain DataFrame -> DataFrame functions."""
