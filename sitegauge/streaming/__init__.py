"""Streams: the step logs, pages and signals as they arrive."""
