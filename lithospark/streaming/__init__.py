"""Event streams: windows, sessions and custom state. An extension."""
