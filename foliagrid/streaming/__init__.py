"""An addition: indicators of tiles as they arrive."""
