"""Runnable jobs: each a function of a session and plain paths, with a command line and a small config file."""
