"""The stages end to end: each plan reads one layer and writes the next."""
