"""Writers: event logs, summaries, text reports."""
