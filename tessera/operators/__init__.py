"""Dataset-level metrics over boxes, image features and annotated instances."""
