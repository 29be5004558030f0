"""Readers and writers of lines, and profiles of files."""
