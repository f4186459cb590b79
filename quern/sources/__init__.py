"""Reading tables, nesting them into documents, sampling and writing results."""
