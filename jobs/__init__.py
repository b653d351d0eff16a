"""Runnable jobs over tables: each is a function that takes a session, a command line and a configuration file."""
