"""Streams of flows: tailed log folders and event-time windows per address."""

from flowlens.streaming.flows import stream_flows
from flowlens.streaming.windows import ip_windows, run_ip_windows

__all__ = [name for name in dir() if not name.startswith("_")]
