"""Readers and writers: binary telemetry logs, event folders, correction logs, numbered options."""
