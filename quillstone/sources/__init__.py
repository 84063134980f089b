"""Reading tables and files, and the versioned passage store."""
