"""Writers and response payloads."""
