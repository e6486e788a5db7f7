"""Part of engram."""
