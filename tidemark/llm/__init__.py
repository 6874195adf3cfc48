"""Training-data operators: dedup, language models, extraction, tokenising, scans."""
