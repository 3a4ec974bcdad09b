"""DataFrame-to-DataFrame operators; each names its keys and columns as parameters."""
