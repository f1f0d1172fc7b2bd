"""Reading and writing: filings, JSON lines with lineage, id lists, manifests, report tables."""
