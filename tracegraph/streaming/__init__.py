"""streaming of tracegraph."""
