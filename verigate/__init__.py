"""verigate: verified-change corpora and audited acceptance verdicts on Spark."""
