"""Label and image folders that still grow, as Structured Streaming sources."""
