"""Runnable plans over the driver tables, each next to its reference SQL."""
