"""Plan-level helpers: written stage tables and iterative graph plans."""
