"""Whole runs: which queries a report needs, and what follows from their results."""
