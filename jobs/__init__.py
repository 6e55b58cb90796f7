"""Runnable jobs over landed tables; each file has a command line and a config beside it."""
