"""Readers and writers: landing files, the event log and JSON replies."""
