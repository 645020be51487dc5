"""DataFrame-level jobs: redaction, findings, audits."""
