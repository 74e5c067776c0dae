"""Column-level building blocks: numbers, text tags, entropy, detail flags."""
