"""An audit trail derived from change sets."""
