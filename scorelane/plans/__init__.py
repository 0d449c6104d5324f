"""End-to-end plans: building an index, scoring requests, evaluating decisions."""
