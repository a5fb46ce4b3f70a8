"""The quality-control modules as DataFrame queries over reads; each is keyed by file_name, so many files run in one job."""
