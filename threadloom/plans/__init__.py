"""Per-conversation plans: what depends on the order of calls and can't be one window."""
