"""Runnable jobs over the tables; each has a command line and a small config file beside it."""
