"""Part of quoin; see the README."""
