"""Readers, and the snapshots that writes leave."""
