"""Reading tables in and writing results out."""
