"""Relational operators on intervals, k-mers, rules and rankings."""
