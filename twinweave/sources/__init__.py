"""Sources: file listings, image headers and metadata, video properties."""
