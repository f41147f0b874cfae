"""DataFrame-to-DataFrame operators over captures, events and sources."""
