"""Pump-and-dump detection on trade tapes, written as Spark DataFrame jobs."""
