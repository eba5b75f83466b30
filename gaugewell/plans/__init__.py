"""Plan builders: joins and graph steps Catalyst can't derive by itself."""
