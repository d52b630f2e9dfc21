"""Part of docketlake: sources."""
