"""Part of docketlake: streaming."""
