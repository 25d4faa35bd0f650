"""Tables of price-like bars, from test tables or files, and the manifest of a snapshot."""
