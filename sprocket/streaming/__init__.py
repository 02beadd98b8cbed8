"""Package `sprocket.streaming`."""
