"""leadlake."""
