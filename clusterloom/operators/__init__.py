"""Relational, graph and statistics operators over clusters."""
