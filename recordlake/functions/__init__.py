"""Column-level building blocks (scalar functions X1–X19, JSON access, redaction)."""
