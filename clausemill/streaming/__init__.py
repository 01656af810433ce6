"""Structured Streaming forms (an extension: batch is what the engine is measured by)."""
