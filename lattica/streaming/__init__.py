"""Event-time twins of batch operators (an extension)."""
