"""Readers of requests, streams and transcripts, and writers of ledgers and masked requests."""
