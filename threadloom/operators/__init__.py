"""Set-oriented operators over messages, blocks and search documents."""
