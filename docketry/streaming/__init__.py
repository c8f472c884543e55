"""Structured Streaming variants of metering and incremental embedding."""
