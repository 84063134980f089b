"""Streaming jobs: ingestion of arriving files, request rates, answer events."""
