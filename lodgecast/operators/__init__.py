"""Booking operators; each takes and returns DataFrames."""
