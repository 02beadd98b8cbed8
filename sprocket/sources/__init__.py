"""Package `sprocket.sources`."""
