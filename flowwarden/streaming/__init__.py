"""Structured Streaming: flow sources, windowed detectors, keyed state, sinks.

The detectors in ``windows`` are plain DataFrame functions: the same call
runs on a batch table (for reports and oracle checks) and on a streaming
frame with a watermark (closed windows are appended once).
"""
