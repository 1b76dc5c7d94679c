"""operators of tracegraph."""
