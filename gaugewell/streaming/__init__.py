"""Reports on streams: what can be added up batch by batch."""
