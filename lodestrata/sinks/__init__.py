"""Writers of what analyses found."""
