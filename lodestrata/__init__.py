"""Source profiling, telemetry forensics and training-data preparation as Spark plans."""
