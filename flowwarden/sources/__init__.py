"""Sources and sinks: table readers, CSV/packet-file readers, flow streams, alert sinks."""
