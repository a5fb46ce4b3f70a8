"""Readers of sequencing files, and the writer of FASTQ."""
