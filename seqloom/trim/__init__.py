"""Adapter detection, quality and adapter trimming, clipping, filtering and pairing of reads."""
