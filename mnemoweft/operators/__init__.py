"""Operators on topics, memories, turns and edges."""
