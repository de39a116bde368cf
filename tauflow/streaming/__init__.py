"""Structured Streaming forms of the collector, the trigger and the policy."""
