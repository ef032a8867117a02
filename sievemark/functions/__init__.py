"""Column functions: geometry of boxes, paths and texts, identities."""
