"""Structured Streaming forms of the session operator."""

from idlecost.streaming.cluster_sessions import streaming_cluster_sessions
from idlecost.streaming.sessions import start_session_stream, streaming_idle_sessions

__all__ = ["start_session_stream", "streaming_cluster_sessions", "streaming_idle_sessions"]
