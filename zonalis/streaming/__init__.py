"""Watching runs as streams."""

from zonalis.streaming.monitor import keep_snapshot, newest, polled, shown_state, watch, with_warnings

__all__ = ["keep_snapshot", "newest", "polled", "shown_state", "watch", "with_warnings"]
