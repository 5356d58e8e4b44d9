"""Operators for preparing training data: near-duplicates, search, coding, scoring, rules, mixing."""
