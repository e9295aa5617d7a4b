"""Where catalogue relations come from: tables, listings, book files."""
