"""Relational, window, graph and rule operators of the engine."""
