"""Event-time windows on Structured Streaming; the same functions take static frames."""

from lattica.streaming.windows import read_events, run_to_memory, sessions, sliding, tumbling

__all__ = ["read_events", "run_to_memory", "sessions", "sliding", "tumbling"]
