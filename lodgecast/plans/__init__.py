"""Reusable distributed plan shapes."""
