"""functions of tracegraph."""
