"""Labels, photos, predictions and results."""
