"""Readers, writers and the derived parsed corpus."""
