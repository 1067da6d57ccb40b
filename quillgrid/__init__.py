"""quillgrid: Spark-first analytics for spreadsheet-style financial models."""
