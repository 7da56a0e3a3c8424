"""Readers and writers for records, findings, test results, manifests."""
