"""sources of tracegraph."""
