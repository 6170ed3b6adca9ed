"""Table readers, overlays, policy bundles and sinks."""
