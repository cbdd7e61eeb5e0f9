"""Reading raw pages, keeping the stored tables, exporting results."""
