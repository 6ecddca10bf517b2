"""Readers, writers and file discovery."""
