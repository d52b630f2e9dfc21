"""Part of docketlake: operators."""
