"""Readers, writers and input views."""
