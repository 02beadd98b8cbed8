"""Package `sprocket.functions`."""
