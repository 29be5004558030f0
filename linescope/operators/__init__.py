"""Operators over lines, hits, blocks, rules and marks."""
