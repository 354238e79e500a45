"""Landed payloads and boards to posting rows."""
