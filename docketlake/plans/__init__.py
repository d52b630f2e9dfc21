"""Part of docketlake: plans."""
