"""Package `sprocket.operators`."""
