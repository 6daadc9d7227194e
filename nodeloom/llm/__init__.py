"""Training-data operators; nothing else in ``nodeloom`` imports this subpackage."""
