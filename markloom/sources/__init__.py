"""Landed exports in, result tables out."""
