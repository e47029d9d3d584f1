"""Runnable jobs: a function taking a session each, and a command line."""
