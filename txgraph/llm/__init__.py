"""Training-data operators: token counts, licence scans, near-duplicates, BPE, language id,
secret scans, benchmark decontamination, quality rules, WARC and quality classification."""
