"""Declarative fault rules and their compilation to DataFrame joins."""
